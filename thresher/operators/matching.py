"""From properties to validated records.

Requested fields: job_id, field, field_ord, type, aliases, paths, required. Properties:
job_id and the columns of discovery. Every step is a function from DataFrames to
DataFrames; jobs of any number are handled at once, and the rows of a job meet in sorted joins, as
fields and properties are as many as jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import values as v
from ..sources.staging import spread

# Confidence of each rule, names that stand for one another, and the rank of sources.
RULES = (("PATH", 1.0), ("EXACT_NAME", 0.98), ("EXACT_ALIAS", 0.95), ("NORMALIZED", 0.9), ("SYNONYM", 0.85))
SYNONYMS = {"title": "headline", "headline": "title", "url": "link", "link": "url", "description": "summary", "summary": "description"}
SOURCES = {"JSON_LD": 5, "MICRODATA": 4, "META": 3, "NETWORK": 2, "DOM": 1}


def _keyed(fields: DataFrame) -> DataFrame:
    """A row for each way in which a property can match a field: rule and the key to equal."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    paths = F.coalesce("paths", F.array().cast("array<string>"))
    names = F.concat(F.array("field"), aliases)
    synonyms = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    ways = F.concat(
        F.transform(paths, lambda p: F.struct(F.lit(0).alias("rule"), t.normalize_path(p).alias("match"))),
        F.array(F.struct(F.lit(1).alias("rule"), F.col("field").alias("match"))),
        F.transform(aliases, lambda a: F.struct(F.lit(2).alias("rule"), t.normalize_simple(a).alias("match"))),
        F.transform(names, lambda n: F.struct(F.lit(3).alias("rule"), t.normalize_identifier(n).alias("match"))),
        F.array(F.struct(F.lit(4).alias("rule"), synonyms[t.normalize_identifier(F.col("field"))].alias("match"))),
    )
    return fields.select("job_id", "field", "field_ord", F.inline(F.array_distinct(ways))).where("match is not null and (rule <> 3 or match <> '')")


def match(fields: DataFrame, properties: DataFrame) -> DataFrame:
    """Candidates: for every field and property the first rule that holds.

    The rules are equalities of normalised keys, so this is one join on job, rule and key,
    spread over the cluster; a field and a property that meet in several ways keep the best.
    """
    keys = F.array(
        F.struct(F.lit(0).alias("rule"), t.normalize_path(F.col("path")).alias("match")),
        F.struct(F.lit(1).alias("rule"), F.col("key").alias("match")),
        F.struct(F.lit(2).alias("rule"), t.normalize_simple(F.col("key")).alias("match")),
        F.struct(F.lit(3).alias("rule"), t.normalize_identifier(F.col("key")).alias("match")),
        F.struct(F.lit(4).alias("rule"), t.normalize_identifier(F.col("key")).alias("match")),
    )
    found = properties.withColumn("ways", keys).select("*", F.inline("ways")).drop("ways").join(spread(_keyed(fields)), ["job_id", "rule", "match"])
    best = Window.partitionBy("job_id", "field", "field_ord", "ext_ord", "prop_ord").orderBy("rule")
    found = found.withColumn("nth", F.row_number().over(best)).where("nth = 1")
    confidence = F.element_at(F.array(*(F.lit(c) for _, c in RULES)), F.col("rule") + 1)
    name = F.element_at(F.array(*(F.lit(n) for n, _ in RULES)), F.col("rule") + 1)
    evidence = F.struct("extractor_id", "source", "vocabulary", F.col("path").alias("location"), "snippet")
    return found.select(
        "job_id", "field", "field_ord", "ext_ord", "prop_ord", name.alias("rule"), confidence.alias("confidence"), "value", evidence.alias("evidence")
    )


def group_candidates(candidates: DataFrame) -> DataFrame:
    """The candidates of each field as an array, in order of discovery."""
    one = F.struct("ext_ord", "prop_ord", "rule", "confidence", "value", "evidence")
    return candidates.groupBy("job_id", "field", "field_ord").agg(F.array_sort(F.collect_list(one), _in_order).alias("candidates"))


def _in_order(a: Column, b: Column) -> Column:
    return F.when(a["ext_ord"] != b["ext_ord"], F.signum(a["ext_ord"] - b["ext_ord"])).otherwise(F.signum(a["prop_ord"] - b["prop_ord"])).cast("int")


def missing(fields: DataFrame, candidates: DataFrame) -> DataFrame:
    """Requested fields without a candidate."""
    return fields.join(spread(candidates.select("job_id", "field").distinct()), ["job_id", "field"], "left_anti")


def _names(condition: Column, name: str) -> Column:
    rows = F.array_sort(F.collect_list(F.when(condition, F.struct("field_ord", "field"))))
    return F.transform(rows, lambda r: r["field"]).alias(name)


def extraction(jobs: DataFrame, fields: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row for each job: status PARSED, PARTIAL or NO_DATA, and the missing fields in order."""
    met = candidates.select("job_id", "field").distinct().withColumn("met", F.lit(True))
    per = fields.join(spread(met), ["job_id", "field"], "left").groupBy("job_id").agg(
        F.count("*").alias("n"), F.count_if("met").alias("n_met"), _names(F.col("met").isNull(), "missing_fields")
    )
    status = F.when(F.coalesce("n_met", F.lit(0)) == 0, "NO_DATA").when(F.col("n") == F.col("n_met"), "PARSED").otherwise("PARTIAL")
    out = jobs.select("job_id").join(spread(per), "job_id", "left")
    return out.select("job_id", status.alias("status"), F.coalesce("missing_fields", F.array().cast("array<string>")).alias("missing_fields"))


def resolve(candidates: DataFrame) -> DataFrame:
    """The winner of each field: confidence, then source, then order of discovery."""
    rank = F.create_map(*(F.lit(x) for pair in SOURCES.items() for x in pair))[F.col("evidence.source")]
    key = F.struct(F.col("confidence"), F.coalesce(rank, F.lit(0)).alias("rank"), (-F.col("ext_ord")).alias("a"), (-F.col("prop_ord")).alias("b"))
    # An aggregate, so what a task holds of a job is reduced before the exchange.
    best = F.max_by(F.struct("value", "confidence", "evidence", "rule"), key)
    return candidates.groupBy("job_id", "field", "field_ord").agg(best.alias("best")).select("job_id", "field", "field_ord", "best.*")


def normalize(fields: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalized fields (type, original_value, value), and issues for what doesn't convert."""
    typed = fields.select("job_id", "field", "type").join(spread(resolved), ["job_id", "field"])
    tried = typed.withColumnRenamed("value", "original_value").withColumn("tried", v.convert(F.col("original_value"), F.col("type")))
    good = tried.where("tried.code is null").select(
        "job_id", "field", "field_ord", "type", "original_value", F.col("tried.value").alias("value"), "confidence", "evidence"
    )
    issues = tried.where("tried.code is not null").select(
        "job_id", "field", "field_ord", F.col("tried.code").alias("code"),
        v.issue_message(F.col("field"), F.col("type"), F.col("tried.code")).alias("message"), "original_value", F.col("type").alias("expected_type"),
    )
    return good, issues


def validate(jobs: DataFrame, fields: DataFrame, normalized: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each job (VALID, PARTIAL or INVALID, and the field lists), and validation issues."""
    failed = issues.groupBy("job_id", "field").agg(F.min(F.struct("code", "message")).alias("issue"))
    held = normalized.select("job_id", "field", F.col("type").alias("declared"), "value")
    rows = fields.join(spread(failed), ["job_id", "field"], "left").join(spread(held), ["job_id", "field"], "left")
    required = F.coalesce("required", F.lit(False))
    state = (
        F.when(F.col("issue").isNotNull(), "FAILED").when(F.col("value").isNull(), "MISSING")
        .when(v.matches_type(F.col("value"), F.col("declared"), F.col("type")), "VALID").otherwise("MISMATCH")
    )
    rows = rows.withColumns({"state": state, "needed": required})
    quoted = lambda before, after: F.concat(F.lit(before), "field", F.lit(after))
    code = (
        F.when(F.col("state") == "FAILED", "NORMALIZATION_FAILED").when((F.col("state") == "MISSING") & F.col("needed"), "MISSING_REQUIRED_FIELD")
        .when(F.col("state") == "MISMATCH", "TYPE_MISMATCH")
    )
    message = (
        F.when(F.col("code") == "NORMALIZATION_FAILED", quoted('Normalization failed for field "', '".'))
        .when(F.col("code") == "MISSING_REQUIRED_FIELD", quoted('Required field "', '" is missing.'))
        .otherwise(F.concat(quoted('Field "', '" does not match requested type '), F.col("type"), F.lit(".")))
    )
    found = rows.withColumn("code", code).where("code is not null").select("job_id", "field", "field_ord", "code", message.alias("message"))
    valid = F.col("state") == "VALID"
    per = rows.groupBy("job_id").agg(
        F.count("*").alias("n"), F.count_if(valid).alias("n_valid"), F.bool_or(F.col("needed") & ~valid).alias("lacks"),
        _names(valid, "valid_fields"), _names(F.col("state").isin("FAILED", "MISMATCH"), "invalid_fields"), _names(F.col("state") == "MISSING", "missing_fields"),
    )
    status = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "INVALID").when(F.col("lacks") | (F.col("n_valid") == 0), "INVALID").when(F.col("n") == F.col("n_valid"), "VALID").otherwise("PARTIAL")
    )
    none = F.array().cast("array<string>")
    lists = [F.coalesce(c, none).alias(c) for c in ("valid_fields", "invalid_fields", "missing_fields")]
    return jobs.select("job_id").join(spread(per), "job_id", "left").select("job_id", status.alias("status"), *lists), found


def outcome(validation: DataFrame) -> DataFrame:
    """COMPLETE with quality FULL or PARTIAL, or PARSER_FAILURE with the error."""
    bad = F.col("status") == "INVALID"
    return validation.select(
        "job_id", F.when(bad, "PARSER_FAILURE").otherwise("COMPLETE").alias("decision"),
        F.when(F.col("status") == "VALID", "FULL").when(F.col("status") == "PARTIAL", "PARTIAL").alias("quality"),
        F.when(bad, F.lit("Parser validation failed with status INVALID.")).alias("error"),
    )
