"""The corpus operators as registered queries, and SQL for those that SQL expresses."""

from __future__ import annotations

from . import (
    approximate_neighbours, bpe, fill_in_middle, language, merkle, packing, quality_classifier, quality_rules, secrets, sharding, simhash, toxicity, warc,
)

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_approximate_neighbours": approximate_neighbours.op2_approximate_neighbours,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_secret_scans": secrets.op5_secret_scans,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_packing": packing.op7_packing,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_warc": warc.op10_warc,
    "op11_language_id": language.op11_language_id,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}


def _merkle_sql(depth: int = 6) -> str:
    """Trees of at most 16^depth leaves; a level over a single node is that node."""
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
    shown = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(shown, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS shown FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, '' AS proof, shown AS fold FROM d)",
        "l0 AS (SELECT g, pos, leaf AS h FROM a0)",
    ]

    def climb(a: str, l: str, group: str) -> None:  # noqa: E741
        for k in range(depth):
            steps.append(f"{l}n{k} AS (SELECT g, pos // 16 AS run, count(*) AS n, sum(count(*)) OVER (PARTITION BY g) AS whole, string_agg(h, '' ORDER BY pos) AS hs FROM {l}{k} GROUP BY 1, 2)")
            steps.append(f"{l}{k + 1} AS (SELECT g, run AS pos, CASE WHEN whole = 1 THEN hs ELSE sha256(hs) END AS h FROM {l}n{k})")
            left, right = "substr(hs, 1, 64 * CAST(a.pos % 16 AS INT))", "substr(hs, 64 * CAST(a.pos % 16 AS INT) + 65)"
            steps.append(
                f"{a}{k + 1} AS (SELECT a.* REPLACE (a.pos // 16 AS pos, CASE WHEN whole = 1 THEN proof ELSE proof || {left} || {right} END AS proof, "
                f"CASE WHEN whole = 1 THEN fold ELSE sha256({left} || fold || {right}) END AS fold) FROM {a}{k} a JOIN {l}n{k} n ON n.g = a.{group} AND n.run = a.pos // 16)"
            )

    climb("a", "l", "g")
    steps += [
        f"s0 AS (SELECT '' AS g, row_number() OVER (ORDER BY l.g) - 1 AS pos, h, l.g AS name FROM l{depth} l)",
        f"b0 AS (SELECT a.* REPLACE (s0.pos AS pos), '' AS top, s0.h AS subroot FROM a{depth} a JOIN s0 ON s0.name = a.g)",
    ]
    climb("b", "s", "top")
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.h AS verified FROM b{depth}, s{depth} r"


#: The others draw at random, hash or learn in ways that SQL lacks; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept FROM pages),
q AS (SELECT *, CAST(strlen(html) AS BIGINT) AS payload_bytes, strlen(html) >= 1000 AND page_id <> kept AS again FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN kept END AS refers_to FROM q""",
    "op12_merkle_manifest": _merkle_sql(),
    # By places in the text, where the operator slices lists of lines.
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, list_transform(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), lambda x: length(x)) AS sizes, list_transform(range(4), lambda k: CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT)) AS r FROM d),
c AS (SELECT *, CAST(len(sizes) AS BIGINT) AS n, least(r[1] % (len(sizes) + 1), r[2] % (len(sizes) + 1)) AS a, greatest(r[1] % (len(sizes) + 1), r[2] % (len(sizes) + 1)) AS b FROM u),
p AS (SELECT *, CAST(coalesce(list_sum(sizes[1:a]), 0) AS BIGINT) AS x, CAST(coalesce(list_sum(sizes[1:b]), 0) AS BIGINT) AS y,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
o AS (SELECT *, substr(text, 1, x) AS prefix, substr(text, x + 1, y - x) AS middle, substr(text, y + 1) AS suffix FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM o""",
}
