"""Live fetching: HEAD, then GET for HTML, hosts dealt to tasks that keep each one's delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.urls import netloc
from auditloom.session import ship

TIMEOUT = 16
WEB_SCHEMA = "asked string, url string, code int, reason string, content string, content_type string, size bigint, encoding string, response_time float, hops array<struct<url:string,code:int,reason:string,content:string,content_type:string,size:bigint,encoding:string,response_time:float>>"


def fetch_one(url: str, agent: str | None = None, full: bool = True, opener=None) -> dict:
    """The response of one URL; failures give code 0 and a reason."""
    import time
    import urllib.error
    import urllib.request

    hops: list[dict] = []

    class Redirects(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, req, fp, code, msg, headers, newurl):
            hops.append({"url": req.full_url, "code": code, "reason": msg, "content": "", "content_type": (headers.get("content-type") or "").split(";")[0] or None, "size": int(headers.get("content-length") or 0), "encoding": None, "response_time": 0.0})
            return super().redirect_request(req, fp, code, msg, headers, newurl)

    opener = opener or urllib.request.build_opener(Redirects)
    began = time.time()

    def ask(method: str) -> dict:
        req = urllib.request.Request(url, method=method, headers={"User-Agent": agent} if agent else {})
        try:
            r = opener.open(req, timeout=TIMEOUT)
        except urllib.error.HTTPError as e:
            r = e
        kind, charset = r.headers.get("content-type") or "", r.headers.get_content_charset() or "utf-8"
        text = r.read().decode(charset, "replace") if method == "GET" else ""
        return {"url": r.url, "code": r.status, "reason": r.reason, "content": text, "content_type": kind.split(";")[0] or None, "size": int(r.headers.get("content-length") or len(text)), "encoding": charset}

    try:
        out = ask("HEAD")
        if full and out["content_type"] == "text/html":
            hops.clear()
            out = ask("GET")
    except TimeoutError:
        return {"url": url, "code": 0, "reason": f"Timeout {TIMEOUT}"}
    except (OSError, ValueError) as e:
        return {"url": url, "code": 0, "reason": f"Connection Error {e}"}
    return out | {"response_time": time.time() - began, "hops": hops}


def fetch(urls: DataFrame, agent: str | None = None, full: bool = True, delay_ms: int = 0, hosts: int = 200, batch: int = 8, opener=None) -> DataFrame:
    """A web table for the distinct URLs of ``url``: dealt by host, so a host sees one caller at a time.

    A task asks each of its hosts at most once in ``delay_ms`` after the last answer, and asks others meanwhile. Responses leave the
    worker ``batch`` at a time, so it holds few bodies. opener: what opens requests, for tests.
    """
    names = [c.split(" ")[0] for c in WEB_SCHEMA.split(", ")]

    def run(frames):
        import time

        import pandas as pd

        from auditloom.sources.polite import polite

        rows = []
        for u in polite((x for pdf in frames for x in zip(pdf["_host"], pdf["url"])), delay_ms / 1000, time.monotonic, time.sleep):
            rows.append({n: None for n in names} | fetch_one(u, agent, full, opener) | {"asked": u})
            if len(rows) == batch:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    ship(urls.sparkSession)
    return urls.select("url", netloc(F.col("url")).alias("_host")).distinct().repartition(hosts, "_host").mapInPandas(run, WEB_SCHEMA)
