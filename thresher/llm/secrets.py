"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in every whole text. The hash of each candidate value is counted
over the whole corpus by distinct owners and repositories: a value that many owners or many
repositories hold is a copied example, one that stays with few looks like a live
credential. Long mixed tokens that no pattern names count as findings (kind `generic`) only
if they look live.

Values leave a text only as hashes. Rows carry one finding each, so a text with very many
findings is just many rows.

Defined results: a null text is empty and has no findings; a null owner counts as one
owner; repeated rows are separate rows; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, quoted, table, whole_row

KINDS = ("assign", "access", "hex", "generic")
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "generic": r"[A-Za-z0-9+/_-]{24,}",
}
#: Which group of a pattern is the secret value.
VALUE = {"assign": 2, "access": 0, "hex": 0, "generic": 0}
MARK = "[REDACTED]"
#: A value that more owners or more repositories hold is a copied example.
MAX_OWNERS, MAX_REPOS = 2, 3


def _mixed(value: Column) -> Column:
    """A token of letters and digits with at least ten different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def _matches(docs: DataFrame) -> DataFrame:
    """A row for each match: uid, id, owner, repo, kind, start, stop, hash; positions in code points.

    The gaps between matches, from splitting at the same pattern, give the positions. Texts
    without a match, and matches that fail, leave a row whose kind is null.
    """
    keys = ("uid", "id", "owner", "repo")
    first = docs.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in PATTERNS.items()))
    any_of = lambda k, x: F.when(F.size(f"m_{k}") > 0, x)
    second = first.select(
        *keys,
        *(
            F.arrays_zip(
                F.col(f"m_{k}").alias("m"),
                any_of(k, F.transform(F.split("text", p, -1), F.length)).alias("gap"),
                any_of(k, F.regexp_extract_all("text", F.lit(p), F.lit(VALUE[k]))).alias("v"),
            ).alias(k)
            for k, p in PATTERNS.items()
        ),
    )
    field = lambda z, i, n: F.struct(F.lit(n).alias("kind"), i.alias("i"), z["m"].alias("m"), z["gap"].alias("gap"), z["v"].alias("v"))
    one = lambda n, k: F.filter(F.coalesce(F.transform(k, lambda z, i: field(z, i, n)), F.array()), lambda z: z["m"].isNotNull())
    rows = second.select(*keys, F.inline_outer(F.concat(*(one(n, k) for n, k in enumerate(KINDS)))))
    so_far = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.when(F.col("kind") == 0, F.length("v") >= 8).when(F.col("kind") == 3, _mixed(F.col("v"))).otherwise(F.col("kind").isNotNull())
    placed = rows.select(
        *keys, "kind",
        F.sum(F.col("gap") + F.length("m")).over(so_far).alias("stop"),
        F.length("m").alias("len"),
        fits.alias("fits"),
        F.md5("v").alias("hash"),
    )
    return placed.select(
        *keys,
        F.when(F.col("fits"), F.col("kind")).alias("kind"),
        (F.col("stop") - F.col("len")).alias("start"), "stop", "hash",
    )


def _apart(found: DataFrame) -> DataFrame:
    """Generic matches that overlap one of another kind lose their kind."""
    by_start = Window.partitionBy("uid").orderBy("start")
    base = F.col("kind") < 3
    ends_before = F.max(F.when(base, F.col("stop"))).over(by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    starts_after = F.min(F.when(base, F.col("start"))).over(by_start.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    clear = F.coalesce(ends_before <= F.col("start"), F.lit(True)) & F.coalesce(starts_after >= F.col("stop"), F.lit(True))
    return found.select("*", (base | clear).alias("apart")).withColumn("kind", F.when(F.col("apart"), F.col("kind"))).drop("apart")


def _ready(docs: DataFrame, text_col: str, id_col: str, owner_cols: Sequence[str], repo_cols: Sequence[str], inside: str = "") -> DataFrame:
    """uid, id, owner, repo and text; inside: the struct, with a point after it, that holds the named columns."""
    held = lambda names: [F.col(inside + quoted(c)) for c in names]
    return docs.select(
        "uid", *(c.alias("id") for c in held([id_col])), F.xxhash64(*held(owner_cols)).alias("owner"),
        F.xxhash64(*held(owner_cols), *held(repo_cols)).alias("repo"), *(F.coalesce(c, F.lit("")).alias("text") for c in held([text_col])),
    )


def _judged(ready: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """Findings, and a row whose kind is null for each text that may have none."""
    found = cut(_apart(_matches(ready)), "secret-matches")
    held = cut(
        found.where("kind is not null").groupBy("hash", "owner", "repo").count()
        .groupBy("hash", "owner").agg(F.count("*").alias("repos"))
        .groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos")),
        "secret-owners",
    )
    # Both sides are plain scans here, so a value that very many rows hold can be split.
    spread = found.withColumn("hash", F.when(F.col("kind").isNull(), F.concat(F.lit("-"), "uid")).otherwise(F.col("hash")))
    judged = spread.join(held, "hash", "left").withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    kind = F.when((F.col("kind") < 3) | F.col("live"), F.col("kind"))
    return judged.select("uid", "id", kind.alias("kind"), "start", "stop", "hash", "n_owners", "n_repos", "live")


def scan(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    owner_cols: Sequence[str] = ("source",),
    repo_cols: Sequence[str] = ("source", "lang"),
    max_owners: int = MAX_OWNERS,
    max_repos: int = MAX_REPOS,
) -> DataFrame:
    """docs must have uid, unique for each row. Returns uid, id, kind (index in KINDS), start, stop, hash, n_owners, n_repos, live.

    live: at most max_owners owners and max_repos repositories hold the value. Generic findings that aren't live are left out.
    """
    return _judged(_ready(docs, text_col, id_col, owner_cols, repo_cols), max_owners, max_repos).where("kind is not null")


def _spans_by_row(found: DataFrame) -> DataFrame:
    """uid, id and the row's findings in order of start, then kind."""
    one = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "stop", "live"))
    return found.groupBy("uid").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(one)).alias("spans"))


def redact(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    owner_cols: Sequence[str] = ("source",),
    repo_cols: Sequence[str] = ("source", "lang"),
    max_owners: int = MAX_OWNERS,
    max_repos: int = MAX_REPOS,
) -> DataFrame:
    """docs with each live finding replaced by MARK; copied examples stay."""
    numbered = cut(docs.select(F.monotonically_increasing_id().alias("uid"), whole_row(docs).alias("row")), "secret-docs")
    found = _judged(_ready(numbered, text_col, id_col, owner_cols, repo_cols, "row."), max_owners, max_repos).where("kind is not null")
    live = _spans_by_row(found.where("live")).select(F.col("uid").alias("found_uid"), "spans")
    merged = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (F.element_at(a, -1)["stop"] > s["start"]),
            F.concat(
                F.slice(a, 1, F.size(a) - 1),
                F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["stop"], s["stop"].cast("long")).alias("stop"))),
            ),
        ).otherwise(F.concat(a, F.array(F.struct(s["start"].cast("long").alias("start"), s["stop"].cast("long").alias("stop"))))),
    )
    whole = numbered.join(live, numbered["uid"] == live["found_uid"], "left").select("row", F.col("row." + quoted(text_col)).alias("text"), merged.alias("spans"))
    before = F.transform(
        "spans",
        lambda s, i: F.substring(
            F.col("text"),
            (F.coalesce(F.get("spans", i - 1)["stop"], F.lit(0)) + 1).cast("int"),
            (s["start"] - F.coalesce(F.get("spans", i - 1)["stop"], F.lit(0))).cast("int"),
        ),
    )
    tail = F.substring(F.col("text"), (F.element_at("spans", -1)["stop"] + 1).cast("int"), F.length("text"))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(before, MARK), F.lit(MARK), tail))
    return whole.select(*(text.alias(c) if c == text_col else F.col("row." + quoted(c)).alias(c) for c in docs.columns))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("uid", F.monotonically_increasing_id())
    spans = _spans_by_row(_judged(_ready(docs, "text", "doc_id", ("source",), ("source", "lang")), MAX_OWNERS, MAX_REPOS))
    name = F.array(*(F.lit(k) for k in KINDS))
    shown = lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    joined = lambda x: F.array_join(F.transform(x, shown), ",")
    return spans.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )
