"""The corpus operators applied to their tables with production parameters, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditloom.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))



def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditloom.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), report=True, passage_words=50)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditloom.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.get("fp", F.lit(0)))), 16, "0").alias("fingerprint"), "component_id")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditloom.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditloom.llm.binary_output import token_files

    return token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditloom.llm.decontaminate import contaminated, contamination, items_digest

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_digest(F.col("items")).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditloom.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditloom.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditloom.llm.line_dedup import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents"), report=True)
    return found.select("doc_id", "text", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditloom.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditloom.llm.filter_audit import audit, failures

    return audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditloom.llm.turn_repair import damage_and_repair

    return damage_and_repair(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_pack_sequences, op3_substring_dedup, op4_simhash, op5_personal_data, op6_token_files, op7_decontaminate, op8_language_id, op9_nearest, op10_line_dedup, op11_quality, op12_filter_audit, op13_turn_repair)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_PIECE = "SELECT doc_id, {size} AS size, {key} AS k, i AS a, {end} AS z FROM w WHERE {where}"

#: The others have no plain SQL form that is quick on whole tables; the tests hold them
#: against brute force, exact round trips, recall or held-out accuracy.
ORACLES: dict[str, str] = {
    "op10_line_dedup": f"""WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM split),
solid AS (SELECT *, len(string_split_regex(s, '\\s+')) AS n FROM (SELECT doc_id, i, trim(replace(replace(line, chr(9), ' '), chr(13), ' '), ' ') AS s FROM lines) WHERE s <> ''),
w AS (SELECT doc_id, i, s, n, lead(s) OVER d AS s1, lead(s, 2) OVER d AS s2, lead(n) OVER d AS n1, lead(i) OVER d AS i1, lead(i, 2) OVER d AS i2 FROM solid WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
windows AS ({' UNION ALL '.join(_PIECE.format(size=k, key=key, end=end, where=where) for k, key, end, where in ((1, 's', 'i', 'n >= 50'), (2, 's || chr(10) || s1', 'i1', 'n < 50 AND n1 < 50 AND n + n1 >= 50'), (3, 's || chr(10) || s1 || chr(10) || s2', 'i2', 's2 IS NOT NULL')))}),
found AS (SELECT doc_id, a, z, first_value(doc_id) OVER f AS d0, first_value(z) OVER f AS z0 FROM windows WINDOW f AS (PARTITION BY size, k ORDER BY doc_id, a)),
gone AS (SELECT DISTINCT s.doc_id, s.i FROM found f JOIN solid s ON s.doc_id = f.doc_id AND s.i BETWEEN f.a AND f.z WHERE f.doc_id <> d0 OR a > z0),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS text, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(g.i::VARCHAR, ',' ORDER BY g.i) AS removed FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.removed, '') AS removed FROM documents d LEFT JOIN kept k USING (doc_id)""",
    "op12_filter_audit": r"""WITH t AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY x) AS first_id FROM t),
m AS (SELECT part, doc_id, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) AS c, regexp_matches(x, '[#$%&*|]') AS d, coalesce(doc_id > first_id, false) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS f,
 count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, s::INTEGER AS s, o[s] AS me, CASE WHEN s = 1 THEN '' ELSE o[1:s - 1] END AS prior FROM orders, range(1, 6) r(s)),
met AS (SELECT *, contains(f, me) AS fails, regexp_matches(f, '[' || prior || '.]') AS gone FROM g, steps),
counted AS (SELECT part, o, s, me, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS redundant,
 coalesce(sum(n) FILTER (WHERE f = me), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, o AS filter_order, s AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 (sum(removed) OVER (PARTITION BY part, me))::BIGINT AS shapley FROM counted""",
    "op7_decontaminate": f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM sized)),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, n, i, item_id FROM places JOIN windows USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS names FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(names), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
