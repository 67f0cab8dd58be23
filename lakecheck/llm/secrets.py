"""Secrets in every version of every path, by a ledger of content-addressed blobs.

A version's text is addressed by its digest. Of each (blob, rule, rule version) that is not in the ledger one copy
is scanned; findings are kept per blob and joined back to all paths that hold it. A second run over the same
versions and rules scans nothing; a new rule version scans every blob for that rule alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecheck.llm.storage import written
from lakecheck.llm.text import sha256_hex, text_or_empty


@dataclass(frozen=True)
class SecretRule:
    """Non-overlapping matches of ``pattern`` from the left; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


#: The three base kinds, in the order in which they are listed in a text's spans.
BASE_RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    SecretRule("access", r"AKIA[A-Z0-9]+", least=20),
    SecretRule("hex", r"[0-9a-f]+", least=24),
)
#: Kinds that the ledger adds as rules of their own.
MORE_RULES = (
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", least=1),
    SecretRule("jwt", r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=1),
)
ALL_RULES = BASE_RULES + MORE_RULES
#: Matches whose positions are summed in one go.
BLOCK = 256


def _long_enough(rule: SecretRule) -> str:
    """Pattern that only texts with a match of the rule contain; a quick test before positions are worked out."""
    return rule.pattern.removesuffix("+") + f"{{{rule.least},}}" if rule.kind == "hex" else rule.pattern


def spans(text: Column, rule: SecretRule) -> Column:
    """``array<struct<start, end>>`` in code points, end exclusive; NULL for a text without a match.

    The gaps between matches and the matches themselves, laid end to end, are the text: running sums of their
    lengths are the positions. They are worked out block by block, so no step copies all the spans found before it.
    """
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x))
    judged = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x)) if rule.group else whole
    pieces = F.arrays_zip(gaps.alias("gap"), whole.alias("hit"), judged.alias("judged"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(state: Column, piece: Column) -> Column:
        begin = state["at"] + piece["gap"]
        end = begin + F.coalesce(piece["hit"], F.lit(0))
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        good = F.coalesce(piece["judged"] >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    def block(state: Column, part: Column) -> Column:
        last = state["last"]
        after = F.aggregate(part, F.struct(last["at"].alias("at"), none.alias("found")), step)
        before = F.when(F.size(last["found"]) > 0, F.concat(state["before"], F.array(last["found"]))).otherwise(state["before"])
        return F.struct(after.alias("last"), before.alias("before"))

    # an array of one element binds the pieces to a name, so the text is matched once and not once a block
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: F.slice(p, i * BLOCK + 1, F.lit(BLOCK)))
    blocks = F.transform(F.array(pieces), cut)[0]
    start = F.struct(F.struct(F.lit(0).alias("at"), none.alias("found")).alias("last"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("before"))
    found = F.aggregate(blocks, start, block, lambda s: F.flatten(F.concat(s["before"], F.array(s["last"]["found"]))))
    return F.when(text.rlike(_long_enough(rule)), found)


def _labelled(rule: SecretRule) -> Column:
    named = lambda s: F.struct(F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"), s["start"].alias("start"), s["end"].alias("end"))
    return F.transform(rule.kind, named)


def scan_secrets(versions: DataFrame, text: str, rules: tuple[SecretRule, ...] = ALL_RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(findings, scanned)`` for the blobs of ``versions`` that ``ledger`` has not seen.

    ``scanned``: ``blob, rule, version``, to be added to the ledger. ``findings``: ``blob, rule, version, start,
    end``, one row per span, to be added to the findings so far. A NULL text is the empty blob. Equal texts are
    scanned once, whatever their paths; an empty table scans nothing, nor do versions that the ledger knows.
    """
    wanted = F.array(*(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    texts = versions.select(sha256_hex(text_or_empty(text)).alias("blob"), text_or_empty(text).alias("_text"))
    if ledger is not None:
        pairs = texts.select("blob").distinct().select("blob", F.inline(wanted))
        due = written(pairs.join(ledger, ["blob", "rule", "version"], "left_anti").groupBy("blob").agg(F.collect_set("rule").alias("due")), "due")
        blobs = texts.join(due, "blob").dropDuplicates(["blob"]) if not due.isEmpty() else texts.where(F.lit(False)).withColumn("due", F.array().cast("array<string>"))
    else:
        blobs = texts.dropDuplicates(["blob"]).withColumn("due", F.array(*(F.lit(r.kind) for r in rules)))
    found = [F.when(F.array_contains("due", r.kind), spans(F.col("_text"), r)).alias(r.kind) for r in rules]
    scans = written(blobs.select("blob", "due", *found), "scans")
    scanned = scans.select("blob", F.explode("due").alias("rule")).select("blob", "rule", _versions(rules)[F.col("rule")].alias("version"))
    every = F.flatten(F.array(*(F.coalesce(_labelled(r), F.array()) for r in rules)))
    findings = scans.select("blob", F.explode(every).alias("f")).select("blob", "f.*")
    return findings, scanned


def _versions(rules: tuple[SecretRule, ...]) -> Column:
    return F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.version)))


def spans_by_path(versions: DataFrame, path: str, text: str, findings: DataFrame, rules: tuple[SecretRule, ...] = ALL_RULES) -> DataFrame:
    """One row per version: ``path, blob, found``, all spans of its blob by start, then by the order of ``rules``.

    ``found`` is ``array<struct<start, at, rule, end>>``, empty without findings. Findings of other versions of a rule
    than the one in ``rules`` do not count. Only blobs with findings are on the small side of the join; paths of one
    blob can be split over tasks.
    """
    order = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)))
    per_blob = findings.where(_versions(rules)[F.col("rule")] == F.col("version")).groupBy("blob").agg(
        F.sort_array(F.collect_set(F.struct("start", order[F.col("rule")].alias("at"), "rule", "end"))).alias("found")
    )
    paths = versions.select(F.col(path).alias("path"), sha256_hex(text_or_empty(text)).alias("blob"))
    return paths.join(per_blob, "blob", "left").select("path", "blob", F.coalesce("found", F.array()).alias("found"))
