"""Secret scan with multipart credential linking, in DataFrame operations only.

Base kinds are reported wherever they match. Weak kinds (login names, long opaque keys, endpoints) are
parts of a credential and count only together: an interval join, expressed as windows within each
document, looks for parts of the complementary roles at most ``scope`` code points away, measured from the
end of the one to the start of the other (overlapping parts are 0 apart). Of the parts that start earlier
the greatest end decides, of those that start later the least start. A login needs a secret near it, an
opaque key an identifier, an endpoint both. The windows emit one row per part, never pairs.

Positions come from the pieces that ``split`` leaves between the matches: a running sum of their lengths
per document. Only (document, kind, lengths) rows are shuffled, never texts.

Defined results: a null text counts as empty; a text without parts gives one row with an empty list; rows
that repeat both doc_id and text count once; rows that share only doc_id give one row per text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCOPE = 240


def any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN_WORDS = "|".join([any_case(w) for w in ("password", "passwd", "secret", "token")] + ["[aA][pP][iI]_?[kK][eE][yY]"])
LOGIN_WORDS = "|".join(any_case(w) for w in ("username", "user", "login", "account"))
ASSIGN = rf"""({ASSIGN_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, role, weak, pattern; in the order in which spans with equal start are listed
KINDS = (
    ("assign", "secret", False, ASSIGN),
    ("access", "id", False, "AKIA[A-Z0-9]{16,}"),
    ("hex", "secret", False, "[0-9a-f]{24,}"),
    ("login", "id", True, rf"""({LOGIN_WORDS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]+"""),
    ("key", "secret", True, "[A-Za-z0-9+/]{32,}"),
    ("host", "endpoint", True, r"""(https?|ftp|sftp|ssh|jdbc|postgres|mysql|redis|amqp|mongodb)://[^\x20\x09-\x0D"'<>]+"""),
)
ASSIGN_LEAST = 6  # characters of the assigned value


def _pieces(n: int, kind: str, pattern: str, text):
    """Per match: kind number, position in the list, length of the text before it, its length, whether it counts."""
    def piece(match, gap):
        keep = F.length(F.regexp_extract(match, pattern, 2)) >= ASSIGN_LEAST if kind == "assign" else F.lit(True)
        return F.struct(F.lit(n).alias("kind"), F.length(gap).alias("gap"), F.length(match).alias("size"), keep.alias("ok"))

    found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1), piece)
    return F.when(text.rlike(pattern), found)


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per part: ``key`` (id, text hash), ``kind`` number, ``start``, ``end`` (code points, end
    exclusive); a text without parts gives one row with nulls."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash")).alias("key"),
                       *[_pieces(n, k, p, text).alias(f"p{n}") for n, (k, _, _, p) in enumerate(KINDS)])
    empty = F.array().cast("array<struct<kind:int,gap:int,size:int,ok:boolean>>")
    rows = rows.select("key", F.posexplode_outer(F.concat(*[F.coalesce(f"p{n}", empty) for n in range(len(KINDS))])))
    # the partitioning by key serves every later window and grouping
    rows = (rows.select("key", F.col("pos"), "col.*").repartition("key").dropDuplicates(["key", "pos"]))
    order = Window.partitionBy("key", "kind").orderBy("pos")
    before = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(order)
    rows = rows.withColumn("end", before).withColumn("start", F.col("end") - F.col("size"))
    # what follows the last match has a length but is no match
    return rows.select("key", "kind", F.when(F.col("ok") & F.col("size").isNotNull(), F.col("start")).alias("start"), "end").select(
        "key", F.when(F.col("start").isNotNull(), F.col("kind")).alias("kind"), "start",
        F.when(F.col("start").isNotNull(), F.col("end")).alias("end"))


def _in(column, names) -> F.Column:
    return column.isin([n for n, k in enumerate(KINDS) if k[0] in names or k[1] in names])


def linked(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document and text: ``key`` and ``spans``, the sorted array of (start, kind number, end)."""
    earlier = Window.partitionBy("key").orderBy("start")
    later = Window.partitionBy("key").orderBy(F.desc("start"))
    rows = parts(docs, id_col, text_col)
    roles = {r: _in(F.col("kind"), [r]) for r in ("id", "secret")}
    rows = rows.withColumns({f"end_{r}": F.max(F.when(c, F.col("end"))).over(earlier) for r, c in roles.items()})
    rows = rows.withColumns({f"start_{r}": F.min(F.when(c, F.col("start"))).over(later) for r, c in roles.items()})
    rows = rows.withColumns({f"near_{r}": F.coalesce(F.col(f"end_{r}") >= F.col("start") - scope, F.lit(False))
                             | F.coalesce(F.col(f"start_{r}") <= F.col("end") + scope, F.lit(False)) for r in roles})
    need = (F.when(_in(F.col("kind"), ["login"]), F.col("near_secret"))
            .when(_in(F.col("kind"), ["key"]), F.col("near_id"))
            .when(_in(F.col("kind"), ["host"]), F.col("near_id") & F.col("near_secret"))
            .otherwise(F.col("kind").isNotNull()))
    span = F.struct("start", "kind", "end")
    return rows.groupBy("key").agg(F.sort_array(F.collect_list(F.when(need, span))).alias("spans"))


def listed(spans, base_only: bool = False):
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    if base_only:
        spans = F.filter(spans, lambda s: ~_weak(s))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def _weak(span):
    return span["kind"].isin([n for n, k in enumerate(KINDS) if k[2]])


def count_kind(spans, kind: str):
    number = [k[0] for k in KINDS].index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def redact(docs: DataFrame, mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mask``; overlapping spans become one."""
    spans = linked(docs, scope).where(F.size("spans") > 0)
    # touching or overlapping spans merge: a span starts a run if it starts after all earlier ends
    each = spans.select("key", F.explode("spans").alias("s")).select("key", "s.start", "s.end", "s.kind")
    order = Window.partitionBy("key").orderBy("start", "kind")
    each = each.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    each = each.withColumn("run", F.sum((F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("long")).over(order))
    runs = each.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_runs"))
    runs = runs.select(F.col("key.id").alias("_id"), F.col("key.hash").alias("_hash"), "_runs")
    text = F.col("text")
    joined = docs.join(runs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_hash")), "left")
    kept = F.transform(F.col("_runs"), lambda r, i: F.substring(
        text, F.coalesce(F.try_element_at("_runs", F.when(i > 0, i))["end"], F.lit(0)) + 1,
        r["start"] - F.coalesce(F.try_element_at("_runs", F.when(i > 0, i))["end"], F.lit(0))))
    rest = F.substring(text, F.element_at("_runs", -1)["end"] + 1, F.length(text))
    masked = F.when(F.col("_runs").isNull(), text).otherwise(F.concat(F.array_join(kept, mask), F.lit(mask), rest))
    return joined.select(*[masked.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
