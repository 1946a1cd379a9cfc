"""Explicit numeric proofs: rules declared as patterns with bindings, all of them planned as one pass over claims and sources.

A rule reads a claim of one form into a key (the names that a source must state too) and values, and source segments of its
forms into the same. Every rule's readings of a text are one array, so texts are parsed once, and claims meet observations by
one equi-join on (case, rule, key) whatever number of rules there are. A verdict needs all observations of a claim, of all
rules, to be one and the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.grammar import canonical

#: What counts, numbers, names, units and stages look like, and the words of a change.
COUNT = r"\d{1,3}(?:,\d{3})+|\d+"
NUMBER = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:/\d+)?"
NAME = r"[A-Za-z][\w-]*(?:[ \t]+[\w-]+){0,5}"
UNIT = "(?:documents|texts|articles|sentences|examples|records|items|tokens|samples|pairs|utterances|tweets)"
STAGE = "(?:preprocessing|processing|filtering|post-processing)"
QUOTE = r"[\x60'\"“”]"
DOWN, UP = ("lowered", "reduced", "drop"), ("raised", "increased", "rise")


def plain(text: Column) -> Column:
    """Letters a to z and digits in lower case, with single blanks."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def collection(text: Column) -> Column:
    """A plain name whose last words, data set or dataset, are data."""
    return F.regexp_replace(plain(text), " (?:data set|dataset)$", " data")


def candidates(text: Column) -> Column:
    return F.replace(plain(text), F.lit("logical form candidates"), F.lit("candidates"))


@dataclass(frozen=True)
class Reading:
    """A whole text of one form: ``key`` and ``values`` name its groups, a key's part is a group, (group, reader) or a fixed text.

    ``where`` is a further condition on the groups; ``anywhere``: the form may be a part of the text, once.
    """

    pattern: str
    key: tuple = ()
    values: tuple[int, ...] = ()
    where: Callable[[Callable[[int], Column]], Column] | None = None
    anywhere: bool = False

    def of(self, text: Column, name: str) -> Column:
        body = f"(?i)(?:{self.pattern})" if self.anywhere else f"(?i)^(?:{self.pattern})$"
        group = lambda g: F.regexp_extract(text, body, g)
        part = lambda k: F.lit(k) if isinstance(k, str) else k[1](group(k[0])) if isinstance(k, tuple) else plain(group(k))
        fits = (F.regexp_count(text, F.lit(body)) == 1) if self.anywhere else text.rlike(body)
        fits = fits if self.where is None else fits & self.where(group)
        key = F.concat_ws("\x1f", *map(part, self.key)) if self.key else F.lit("")
        values = F.array(*[canonical(group(v)) for v in self.values]) if self.values else F.array().cast("array<string>")
        return F.when(fits, F.struct(F.lit(name).alias("rule"), key.alias("key"), values.alias("values")))


@dataclass(frozen=True)
class Rule:
    """``before``: a segment next to the observation, earlier in the text, must have one of these readings, whose key is the claim's ``before_key``.

    near: whether an observation may stand beside a selected segment instead of in it.
    """

    name: str
    claim: Reading
    sources: tuple[Reading, ...]
    before_key: tuple | None = None
    before: tuple[Reading, ...] = field(default=())
    near: bool = False


def _moves(word: int, old: int, new: int) -> Callable[[Callable[[int], Column]], Column]:
    """Whether two numbers move as a word says."""
    def holds(group: Callable[[int], Column]) -> Column:
        a, b = (canonical(group(g)).try_cast("double") for g in (old, new))
        return F.coalesce(F.when(F.lower(group(word)).isin(*DOWN), a > b).when(F.lower(group(word)).isin(*UP), a < b), F.lit(False))

    return holds


def _news(reading: Reading, unit: int) -> tuple[Reading, ...]:
    """A reading, and the same with texts and articles as the unit where the source counts news of a kind."""
    place = reading.key.index(unit)
    put = lambda word: Reading(reading.pattern, (*reading.key[:place], word, *reading.key[place + 1 :]), reading.values, lambda g: plain(g(unit)).endswith(" news"))
    return (reading, put("texts"), put("articles"))


#: The forms of claims and sources that are proved, and what binds them.
RULES = (
    Rule(
        "named corpus count",
        Reading(rf"(?:The )?({NAME}) (?:corpus|dataset) (?:contained|contains|had) ({COUNT}) ([a-z]+)\.", (1, 3), (2,)),
        _news(Reading(rf"(?:The |One |Another )?(?:other )?(?:corpus|dataset) \((?:named|called)(?: here)? {QUOTE}([^'\"”\x60]+){QUOTE}\) (?:is a set of|contains|contained|consists of) ({COUNT}) ({UNIT}|{NAME} news)\.", (1, 3), (2,)), 3),
        near=True,
    ),
    Rule(
        "count after preprocessing",
        Reading(rf"The ({NAME}) corpus (?:contained|contains|had) ({COUNT}) ({UNIT}) after ({STAGE})\.", (4, 3), (2,)),
        (Reading(rf"After ({STAGE}), we (?:got|obtained|retained|had) (?:{COUNT}) (?:{NAME} )?{UNIT} in ({COUNT}) ({UNIT})\.", (1, 3), (2,)),),
        before_key=(1,),
        before=tuple(
            Reading(rf"\bwe (?:filter|preprocess|process)(?: and [a-z-]+)? (?:the|a) ({NAME}?) corpus\b", key, anywhere=True, where=where)
            for key, where in (((1,), None), (("aligned",), lambda g: F.lower(g(1)).isin("line-aligned", "document-aligned")))
        ),
    ),
    Rule(
        "count for the named group",
        Reading(rf"After filtering, the (?:collection|dataset|corpus) (?:contained|contains|had) ({COUNT}) ({UNIT}) (?:about|for) (.+)\.", (2, 3), (1,)),
        tuple(
            Reading(
                rf"(?:This|The) (?:automatic )?(?:post-processing|filtering) left us with ({COUNT}) ({UNIT}) for ([^,()]+?) and ({COUNT}) ({UNIT}) for ([a-z ]+?)(?: \(([^()]+)\))?(?: across all events)?\.", key, (value,), where
            )
            for key, value, where in (((2, 3), 1, None), ((5, 6), 4, None), ((5, 7), 4, lambda g: g(7) != ""))
        ),
    ),
    Rule(
        "random sample count",
        Reading(rf"The ({NAME}) (?:method|approach) used ({COUNT}) ({UNIT}) randomly selected from (?:the )?({NAME}) for ({NAME})\.", (1, 3, (4, collection), 5), (2,)),
        (
            Reading(rf"For (?:the )?({NAME}) (?:method|approach), we randomly (?:picked|selected|sampled) ({COUNT}) ({UNIT}) from (?:the )?({NAME}?) for ({NAME})\.", (1, 3, (4, collection), 5), (2,)),
            Reading(rf"For (?:the )?({NAME}) (?:method|approach), we randomly (?:picked|selected|sampled) ({COUNT}) ({UNIT}) from (?:the )?({NAME}?) as ({NAME}) ({UNIT})\.", (1, 3, (4, collection), 5), (2,), lambda g: plain(g(3)) == plain(g(6))),
        ),
    ),
    Rule(
        "ordered percentage",
        Reading(rf"(.+?) covered ({NUMBER})% of (.+?) in (?:the )?({NAME}) dataset\.", (1, 3, 4), (2,)),
        tuple(Reading(rf"(.+?) cover(?:ed|s)? ({NUMBER})% and ({NUMBER})% (?:of )?(.+?) in ({NAME}) and ({NAME}), respectively\.", (1, 4, place), (value,)) for value, place in ((2, 5), (3, 6))),
    ),
    Rule(
        "before/after measurement with the same configuration",
        Reading(rf"With configuration parameters unchanged, training (?:the )?({NAME}) on ({NAME}) (lowered|raised|reduced|increased) ({NAME}) from ({NUMBER})% to ({NUMBER})%\.", (1, 2, 4), (5, 6), _moves(3, 5, 6)),
        (
            Reading(
                rf"We trained (?:the )?({NAME}) on ({NAME}?)(?: generated using (?:the )?{NAME})?, and found its ({NAME}) to (drop|rise) to ({NUMBER})% \(from ({NUMBER})%\); all configur(?:ation|ing) parameters were left unchanged\.",
                (1, (2, candidates), 3), (6, 5), _moves(4, 6, 5),
            ),
        ),
    ),
    Rule(
        "negative-sampling exponent",
        Reading(rf"The standard ({NAME}) negative-sampling distribution uses a smoothing exponent of ({NUMBER})\.", (1,), (2,)),
        (Reading(rf"({NAME}) employs a smoothed unigram distribution with a power rate of ({NUMBER}) as the noise distribution\.", (1,), (2,)),),
        before_key=(),
        before=(Reading(r"\b(?:is|was) the choice of noise distribution for negative sampling\.$", (), anywhere=True),),
    ),
)


def _read(rows: DataFrame, keep: list[str], readings: list[tuple[str, Reading]], text: str = "text") -> DataFrame:
    """(keep, rule, key, values): a row for each reading of a text."""
    found = F.array_compact(F.array(*[r.of(F.trim(text), name) for name, r in readings]))
    return rows.select(*keep, F.explode(found).alias("r")).select(*keep, "r.*")


def explicit_verdicts(claims: DataFrame, windows: DataFrame, segments: DataFrame, case: str = "case_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(claim_id, label, rule, citations): claims that the sources decide, one way, by one proof; others give no row.

    claims: (case, claim_id, text); windows: (claim_id, n, selected): the segments that a claim may be proved by, those that were
    selected for it and the neighbours that belong to them; segments: (case, n, text) in order. citations: the segments of the
    proof, in order. label: support or contradict.
    """
    near = F.array(*[F.lit(r.name) for r in rules if r.near] or [F.lit("")])
    asked = _read(claims, [case, "claim_id"], [(r.name, r.claim) for r in rules])
    wanted = _read(claims, [case, "claim_id"], [(r.name, Reading(r.claim.pattern, r.before_key, (), r.claim.where)) for r in rules if r.before_key is not None]).select(case, "claim_id", "rule", F.col("key").alias("b_key"))
    seen = _read(segments, [case, "n"], [(r.name, s) for r in rules for s in r.sources]).withColumnRenamed("values", "seen").distinct()
    j = asked.join(seen, [case, "rule", "key"]).join(windows.select("claim_id", "n", "selected"), ["claim_id", "n"]).where(F.col("selected") | F.array_contains(near, F.col("rule")))
    j = j.select(case, "claim_id", "rule", "n", (F.col("values") == F.col("seen")).alias("agrees")).distinct()
    # Rules with an antecedent need one in the window, right before the observation.
    above = _read(segments, [case, "n"], [(r.name, b) for r in rules for b in r.before]).select(case, "rule", F.col("key").alias("b_key"), F.col("n").alias("b_n")).distinct()
    with_key = j.join(wanted, [case, "claim_id", "rule"], "left")
    free = with_key.where("b_key is null").select("claim_id", "rule", "agrees", F.array("n").alias("citations"))
    held = with_key.where("b_key is not null").join(above, [case, "rule", "b_key"]).where("b_n = n - 1").join(windows.select("claim_id", F.col("n").alias("b_n")).distinct(), ["claim_id", "b_n"])
    proofs = free.unionByName(held.select("claim_id", "rule", "agrees", F.array("b_n", "n").alias("citations"))).distinct()
    one = proofs.groupBy("claim_id").agg(F.count("*").alias("k"), F.first(F.struct("agrees", "rule", "citations")).alias("p")).where("k = 1")
    return one.select("claim_id", F.when(F.col("p.agrees"), "support").otherwise("contradict").alias("label"), "p.rule", "p.citations")
