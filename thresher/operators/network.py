"""Captured API responses: capture rules, body budgets, and their properties."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import http
from ..functions.text import snippet, trim
from ..functions.values import shown
from ..sources.staging import spread, stage
from .discovery import property_rows, warning_rows
from .flatten import Walk, flatten

# Limits of the scan, and guards against script inclusion.
MAX_RESPONSES, MAX_BODY, MAX_TOTAL = 200, 1_048_576, 4_194_304
GUARDS = r"^(?:\s*(?:\)\]\}',?|while\s*\(\s*(?:1|true)\s*\)\s*;|for\s*\(\s*;\s*;\s*\)\s*;)){0,8}\s*"


@dataclass(frozen=True)
class Limits:
    """How much of a job's responses is inspected. Every limit is a positive integer that a double holds exactly; others raise a ValueError."""

    responses: int = MAX_RESPONSES
    body_bytes: int = MAX_BODY
    total_bytes: int = MAX_TOTAL
    properties: int = 1_500
    all_properties: int = 5_000
    depth: int = 40
    nodes: int = 20_000
    items: int = 1_000
    string: int = 20_000

    def __post_init__(self):
        for name, x in asdict(self).items():
            if isinstance(x, bool) or not isinstance(x, int) or not 0 < x < 2**53:
                raise ValueError(f"{name} must be a positive safe integer, not {x!r}")

    def walk(self) -> Walk:
        return Walk(
            nulls=False, blanks=False, vocabulary=False, max_depth=self.depth, max_nodes=self.nodes, max_items=self.items, max_string=self.string, max_leaves=self.properties
        )


def strip_guards(body: Column) -> Column:
    """Without a byte order mark and up to eight guards against script inclusion."""
    return trim(F.regexp_replace(F.regexp_replace(body, "^\\x{FEFF}", ""), GUARDS, ""))


def looks_like_json(body: Column) -> Column:
    return F.substring(body, 1, 1).isin("{", "[")


def greedy_budget(sizes: Column, budget: int) -> Column:
    """For an array of sizes in order: which fit. What doesn't fit is skipped, and a later smaller one may still."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<boolean>").alias("fits"))

    def step(state: Column, size: Column) -> Column:
        fits = state["used"] + size <= budget
        return F.struct((state["used"] + F.when(fits, size).otherwise(0)).alias("used"), F.array_append(state["fits"], fits).alias("fits"))

    return F.aggregate(sizes, start, step, lambda s: s["fits"])


def within_budget(responses: DataFrame, key: str = "job_id", most: int = MAX_BODY, total: int = MAX_TOTAL, count: int = MAX_RESPONSES) -> DataFrame:
    """responses (key, sequence, body_bytes, ...) with taken: whether the body is small enough and the job's budget still holds it. Null bytes: no body, not taken.

    Sizes of a job meet in one array: at most count of them, as later ones are out anyway.
    """
    first = responses.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("sequence")))
    small = first.where((F.col("nth") <= count) & (F.col("body_bytes") <= most))
    per = small.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", F.col("body_bytes").cast("bigint").alias("size")))).alias("held"))
    fits = greedy_budget(F.transform("held", lambda h: h["size"]), total)
    taken = per.select(key, F.inline(F.arrays_zip(F.transform("held", lambda h: h["nth"]).alias("nth"), fits.alias("taken"))))
    return first.join(spread(taken), [key, "nth"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def capture_summary(responses: DataFrame, key: str = "job_id") -> DataFrame:
    """observed, eligible (xhr or fetch), retained, captured bodies and bytes, and whether the limit of responses was met."""
    eligible = F.col("resource_type").isin("xhr", "fetch")
    ranked = responses.withColumn("eligible", eligible).withColumn("nth", F.when(eligible, F.sum(F.when(eligible, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("sequence"))))
    kept = F.col("nth") <= MAX_RESPONSES
    return ranked.groupBy(key).agg(
        F.count("*").alias("observed"), F.count_if("eligible").alias("eligible"), F.count_if(kept).alias("retained"),
        F.count_if(kept & F.col("body").isNotNull()).alias("captured_bodies"), F.coalesce(F.sum(F.when(kept & F.col("body").isNotNull(), F.col("body_bytes"))), F.lit(0)).alias("captured_bytes"),
        F.coalesce(F.bool_or(F.col("nth") > MAX_RESPONSES), F.lit(False)).alias("limit_reached"),
    )


def capture(responses: DataFrame, key: str = "job_id") -> DataFrame:
    """The retained responses with body_omitted_reason, redacted headers, and the body only where nothing omits it."""
    eligible = responses.where(F.col("resource_type").isin("xhr", "fetch"))
    first = eligible.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("sequence"))).where(F.col("nth") <= MAX_RESPONSES)
    early = http.omission_reason(F.col("content_type"), F.col("declared_bytes"), F.octet_length("body"), F.lit(MAX_TOTAL), F.lit(False), MAX_BODY)
    sized = first.drop("nth").withColumn("early", early).withColumn("body_bytes", F.when(F.col("early").isNull(), F.octet_length("body")).otherwise(0))
    told = within_budget(sized, key).withColumn("body_omitted_reason", F.coalesce("early", F.when(~F.col("taken"), "BUDGET_EXHAUSTED")))
    body = F.when(F.col("body_omitted_reason").isNull(), F.col("body"))
    return told.withColumns({"body": body, "headers": http.redact_headers(F.col("headers"))}).drop("early", "nth", "taken")


def network_properties(responses: DataFrame, key: str = "job_id", limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Properties of the JSON bodies of responses (key, id, sequence, body), and warnings.

    The first limits.responses are inspected, those without a body among them, which have nothing to take.
    """
    some = F.coalesce(trim(F.col("body")), F.lit("")) != ""
    told = within_budget(responses.withColumn("body_bytes", F.when(some, F.octet_length("body"))), key, limits.body_bytes, limits.total_bytes, limits.responses)
    # Staged, as the walk and three of the warnings read it; of bodies only what is walked.
    told = stage(told.select(key, "id", "sequence", "nth", "body_bytes", "taken", F.when(F.col("taken"), F.col("body")).alias("body")), "budgeted")
    ready = told.where("taken").select(key, "id", "sequence", strip_guards(F.col("body")).alias("body")).where(looks_like_json(F.col("body")))
    flat = flatten(ready, "body", [key, "id", "sequence"], limits.walk())
    order = Window.partitionBy(key).orderBy("sequence", "leaf_ord")
    counted = flat.where("path is not null").withColumn("nth", F.row_number().over(order))
    rows = counted.where(F.col("nth") <= limits.all_properties).select(
        key, "sequence", "leaf_ord", F.col("leaf_key").alias("name"), "path", "value", F.lit("OTHER").alias("vocabulary"), F.col("id").alias("source_ref"),
        snippet(shown(F.col("value"))).alias("snippet"),
    )
    code = F.when(F.col("warning") == "PROPERTY_LIMIT_REACHED", "RESPONSE_PROPERTY_LIMIT_REACHED").otherwise(F.col("warning"))
    warned = warning_rows(flat.where("warning is not null"), key, "network", F.concat(F.lit("NETWORK_"), code))
    many = warning_rows(counted.where(F.col("nth") == limits.all_properties + 1), key, "network", F.lit("NETWORK_TOTAL_PROPERTY_LIMIT_REACHED"))
    large = warning_rows(told.where((F.col("body_bytes") > limits.body_bytes) & (F.col("nth") <= limits.responses)), key, "network", F.lit("NETWORK_BODY_TOO_LARGE"))
    spent = told.where(~F.col("taken") & (F.col("body_bytes") <= limits.body_bytes) & (F.col("nth") <= limits.responses)).select(key).distinct()
    extra = told.where(F.col("nth") == limits.responses + 1)
    warnings = warned.unionByName(many).unionByName(large).unionByName(warning_rows(spent, key, "network", F.lit("NETWORK_TOTAL_BODY_BUDGET_REACHED")))
    warnings = warnings.unionByName(warning_rows(extra, key, "network", F.lit("NETWORK_RESPONSE_LIMIT_REACHED")))
    return property_rows(rows, key, "network", "NETWORK", ["sequence", "leaf_ord"]), warnings
