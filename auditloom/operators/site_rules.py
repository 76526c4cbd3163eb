"""Rules that look beyond one parsed page: titles and descriptions that pages share, and bytes that are no UTF-8.

They are options beside the page rules: ``with_site_rules`` adds what they find to the ``lint`` array of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.operators.lint import RESULT, _result

SITE_RULES = ("E01", "W04", "W07")
#: Into how many the rows of one value are dealt when their count is joined back.
SALT = 32


def with_counts(rows: DataFrame, values: dict[str, Column], key: str, scope: tuple[str, ...] = (), salt: int = SALT) -> DataFrame:
    """rows with, for each named value, how many of them have it within their scope; 1 where no other has it, NULL without a value.

    All values are counted in one pass, and counts are reduced before their shuffle. Only values that stand more than once go back, each ``salt``
    times, to rows dealt by value and a hash of their key, so a value that a third of all rows share is joined in ``salt`` tasks.
    """
    kept = [F.col(c).alias(f"_scope{i}") for i, c in enumerate(scope)]
    pairs = F.array(*[F.struct(F.lit(n).alias("_kind"), v.alias("_same")) for n, v in values.items()])
    counts = rows.select(*kept, F.explode(pairs).alias("_p")).select(*[f"_scope{i}" for i in range(len(scope))], "_p._kind", "_p._same").where("_same IS NOT NULL")
    counts = counts.groupBy(*counts.columns).agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    out = rows
    for name, value in values.items():
        own = counts.where(F.col("_kind") == name).drop("_kind")
        on = (value == F.col("_same")) & (F.pmod(F.xxhash64(key), F.lit(salt)) == F.col("_to"))
        for i, c in enumerate(scope):
            on = on & F.col(c).eqNullSafe(F.col(f"_scope{i}"))
        out = out.join(own, on, "left").withColumn(name, F.when(value.isNotNull(), F.coalesce("_n", F.lit(1)))).drop("_same", "_n", "_to", *[f"_scope{i}" for i in range(len(scope))])
    return out


def invalid_utf8(body: Column) -> Column:
    """Whether bytes are no UTF-8; NULL for NULL."""
    return ~F.is_valid_utf8(body.cast("string"))


def with_site_rules(parsed: DataFrame, key: str, scope: tuple[str, ...] = (), body: str | None = None, doc: str = "doc", lint: str | None = None, rules: tuple[str, ...] = SITE_RULES) -> DataFrame:
    """parsed pages, told apart by key, with the rules' results in ``lint``, behind those of the column named lint.

    W04 and W07: other pages of the scope (all, or those equal in the named columns, such as run_id) have the same title or
    description; the number is how many pages have it. Empty ones and pages without a head don't count. E01: the binary column body is no UTF-8.
    """
    found = []
    own = lambda name: F.when(F.col(f"{doc}.has_head"), F.nullif(F.col(f"{doc}.{name}"), F.lit("")))
    if "E01" in rules and body is not None:
        found.append(_result("E01", F.coalesce(invalid_utf8(F.col(body)), F.lit(False))))
    shared = {f"_shared_{name}": (rule, own(name)) for rule, name in (("W04", "title"), ("W07", "description")) if rule in rules}
    out = with_counts(parsed, {n: v for n, (_, v) in shared.items()}, key, scope) if shared else parsed
    found += [_result(rule, F.col(n) > 1, F.col(n)) for n, (rule, _) in shared.items()]
    none = F.array().cast(f"array<{RESULT}>")
    new = F.filter(F.array(*found), lambda r: r.isNotNull()) if found else none
    return out.withColumn("lint", F.concat(F.coalesce(F.col(lint), none), new) if lint else new).drop(*shared)
