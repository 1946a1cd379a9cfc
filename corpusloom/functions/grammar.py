"""Words, numbers and quantities of claims and sources as column expressions. Null text gives null or an empty array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let

#: The grammar of tokens, of numbers and quantities, and their words.
TOKEN = r"(?U)[+−-]?\d+(?:[.,/]\d+)*|[^\W\d_]+(?:[-‐‑][^\W\d_]+)*|[^\s\w]"
#: Tokens but for marks, and those of lower-cased texts of ASCII alone, in which no character class has to ask for properties.
WORD_TOKEN = TOKEN.rpartition("|")[0]
PLAIN_WORD_TOKEN = r"[+-]?[0-9]+(?:[.,/][0-9]+)*|[a-z]+(?:-[a-z]+)*"
NUMBER = r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
QUANTITY = rf"(?iU)(?<![\w.])({NUMBER})(?:\s*(%|percent\b))?(?!\w|\.\d)"
CELL = r"^\s*([+−-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)(\s*%|[kKmMbB])?(?:\s*±\s*[+−-]?\d+(?:\.\d+)?)?\s*$"
FUNCTION_WORDS = "a an the of in on at by as is are was were be been to for and or that this here".split()
CARDINALS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth".split()
DIRECTIONS = {
    "decrease": "reduced reduce decreased decrease lowered lower".split(),
    "increase": "increased increase raised raise".split(),
    "unchanged": ["unchanged"],
}
LOOSE_DIRECTIONS = {"increase": ["rose", "raised", "more"], "decrease": ["fell", "less"]}
SCALES = {"k": 1_000, "m": 1_000_000, "b": 1_000_000_000, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
SCREEN_WORDS = (
    "a an the and or but on in of for to from with by at as than its it that this these those all every each some none no one after before same "
    "uses use used retains retain retained became become was is were are has had improved improves worsened"
).split() + [w for words in DIRECTIONS.values() for w in words]
#: Named numbers that are no quantities, numbered places of a document, and where a list's items and sentences end.
NAMED_NUMBER = r"\b(?:(?i:table|figure|fig\.?|section|appendix|group|fold|phase|chapter|equation)\s+[A-Za-z]?\d+(?:\.\d+)*|[A-Z][A-Za-z0-9]*[-‐‑]\d+(?:\.\d+)*[a-z]?)\b(?![.,]\d|\s*%)"
NUMBERED_PLACE = r"(?iU)(?<![\w/])(?:table|figure|section|appendix)[ \t]+\d+(?:\.\d+)*[a-z]?(?!\w|\.\d|[ \t]*%)"
MEASURED = r"(?U)(?<![\w.])(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:\s*%)?(?!\w|\.\d)"
LIST_ITEM, ITEM_MARK = r"\n\s*(?=[-*•]\s|\d+[.)]\s)", r"^\s*(?:[-*•]|\d+[.)])\s+"
SENTENCE_END = r"(?<=[.!?])\s+(?=[\p{Lu}\p{N}\"'“‘(])"
DECIMAL = "decimal(38,10)"
#: What fits into DECIMAL without rounding, and the base of the parts in which larger products are compared.
FITS, LIMB = r"^-?\d{1,28}(?:\.\d{1,10})?$", 10**13


def _words_of(values: dict | list) -> Column:
    pairs = values.items() if isinstance(values, dict) else [(w, i) for i, w in enumerate(values)]
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def tokens(text: Column) -> Column:
    """Lower-cased numbers (with signs, decimals, fractions), words (with hyphens, all of one kind) and marks, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.translate(F.lower(t), "‑‐", "--"))


def word_tokens(text: Column) -> Column:
    """``tokens`` without single marks; where there are none, nothing or an empty string.

    Texts of ASCII are lower-cased whole and read by a plainer pattern. Others' tokens are lower-cased side by side, a blank
    apart, as a letter's small form may depend on those beside it.
    """
    plain = F.octet_length(text) == F.length(text)
    joined = F.array_join(F.regexp_extract_all(text, F.lit(WORD_TOKEN), F.lit(0)), " ")
    return F.when(plain, F.regexp_extract_all(F.lower(text), F.lit(PLAIN_WORD_TOKEN), F.lit(0))).otherwise(F.split(F.translate(F.lower(joined), "‑‐", "--"), " "))


def key_tokens(text: Column) -> Column:
    """Tokens with a letter or digit that are no function words; ``python_text.nfkc`` first where text isn't in that form."""
    stop = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    return F.filter(word_tokens(text), lambda t: t.rlike(r"[\p{L}\p{N}]") & ~F.array_contains(stop, t))


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def content_words(text: Column) -> Column:
    """Distinct words of letters that are neither function, direction nor number words."""
    return F.array_except(plain_words(text), F.array(*[F.lit(w) for w in [*SCREEN_WORDS, *CARDINALS]]))


def canonical(text: Column) -> Column:
    """One spelling for each value of a decimal literal of any length: no commas, plus, needless zeros or point; -0 is 0."""
    bare = F.translate(text, "−,+ \t\n\x0b\f\r", "-")
    short = lambda b: F.regexp_replace(F.regexp_replace(b, r"^(-?)0+(?=\d)", "$1"), r"(\.\d*?)0+$", "$1")
    # Most are spelt so already.
    return let(bare, lambda b: F.when(b.rlike(r"^-?[1-9][0-9]*$"), b).otherwise(F.regexp_replace(F.regexp_replace(short(b), r"\.$", ""), "^-0$", "0")))


def exact_decimal(spelling: Column) -> Column:
    """A canonical spelling as DECIMAL where that holds it exactly, else null."""
    return F.when(spelling.rlike(FITS), spelling.try_cast(DECIMAL))


def number(text: Column) -> Column:
    """(num, den, exact), the exact rational of a literal: digits with commas and decimals, a fraction, a cardinal or ordinal word, any with -fold; null for others.

    exact spells a number that is no fraction, whatever its length; num and den are null where DECIMAL can't hold them.
    """
    value = F.regexp_replace(F.translate(F.lower(text), "−", "-"), "-?fold$", "")
    small = {w: i for i, w in enumerate(CARDINALS[:11])} | {w: i for i, w in enumerate(ORDINALS, 1)}
    word = _words_of(small)[value].cast(DECIMAL)
    part = r"[+-]?(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d+)?"
    pieces = F.transform(F.split(value, "/"), canonical)
    one = F.lit(1).cast(DECIMAL)
    top, below = F.get(pieces, F.lit(0)), F.get(pieces, F.lit(1))
    den = F.when(F.size(pieces) > 1, exact_decimal(below)).otherwise(one)
    plain = F.when((F.size(pieces) == 1) | (below == "1"), top)
    fine = value.rlike(rf"^{part}(?:/{part})?$") & ((F.size(pieces) == 1) | (below != "0"))
    read = F.when(fine, F.struct(exact_decimal(top).alias("num"), den.alias("den"), plain.alias("exact")))
    return F.coalesce(F.when(word.isNotNull(), F.struct(word.alias("num"), one.alias("den"), _words_of(small)[value].cast("string").alias("exact"))), read)


def same_number(a: Column, b: Column) -> Column:
    """Whether two rationals are equal, exactly; null where either is, or a fraction is too long for DECIMAL."""
    same_spelling = F.when(a["exact"].isNotNull() & b["exact"].isNotNull(), a["exact"] == b["exact"])
    return F.coalesce(same_spelling, _product(a["num"], b["den"]) == _product(b["num"], a["den"]))


def _product(x: Column, y: Column) -> Column:
    """The product of two DECIMALs as its sign and parts in base LIMB, so that equal products are equal arrays."""

    def limbs(v: Column) -> list[Column]:
        digits = F.lpad(F.when(v == 0, "0").otherwise(F.translate(F.abs(v).cast("string"), ".", "")), 39, "0")
        return [F.substring(digits, 27 - 13 * k, 13).cast("decimal(38,0)") for k in range(3)]

    a, b = limbs(x), limbs(y)
    parts, carry = [], F.lit(0).cast("decimal(38,0)")
    for k in range(5):
        total = carry
        for i in range(max(0, k - 2), min(k, 2) + 1):
            total = total + (a[i].cast("decimal(14,0)") * b[k - i].cast("decimal(14,0)")).cast("decimal(38,0)")
        total = total.cast("decimal(38,0)")
        parts.append((total % LIMB).cast("decimal(38,0)"))
        carry = F.floor(total / F.lit(LIMB).cast("decimal(14,0)")).cast("decimal(38,0)")
    sign = F.signum(x.cast("double")) * F.signum(y.cast("double"))
    return F.when(x.isNotNull() & y.isNotNull(), F.array(sign.cast("decimal(38,0)"), *parts, carry))


def quantities(text: Column, claim: bool = False) -> Column:
    """Distinct (value, kind: percent or number, exact) of a text; in a claim, 'at least one' and 'one or more' are no quantity.

    exact spells the value whatever its length; value is null where DECIMAL can't hold it.
    """
    if claim:
        text = F.regexp_replace(text, r"(?i)\b(?:at least one|one or more)\b", "")
    return let(text, _quantities)


def _quantities(text: Column) -> Column:
    values, marks = (F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(g)) for g in (1, 2))
    digits = F.zip_with(values, marks, lambda v, m: let(canonical(v), lambda c: F.struct(exact_decimal(c).alias("value"), F.when(m == "", "number").otherwise("percent").alias("kind"), c.alias("exact"))))
    known = F.filter(F.transform(plain_words(text), lambda w: F.try_element_at(_words_of(CARDINALS), w)), lambda n: n.isNotNull())
    words = F.transform(known, lambda n: F.struct(n.cast(DECIMAL).alias("value"), F.lit("number").alias("kind"), n.cast("string").alias("exact")))
    return F.array_distinct(F.concat(digits, words))


def missing_quantities(claim: Column, source: Column) -> Column:
    """Quantities of a claim that its source doesn't hold."""
    return F.array_except(quantities(claim, claim=True), quantities(source))


def direction(text: Column, loose: bool = False) -> Column:
    """increase, decrease or unchanged, where a text's direction words agree; loose: rose, fell, more and less are some too."""
    words = {w: d for d, ws in DIRECTIONS.items() for w in ws} | ({w: d for d, ws in LOOSE_DIRECTIONS.items() for w in ws} if loose else {})
    found = F.array_distinct(F.filter(F.transform(plain_words(text), lambda w: F.try_element_at(_words_of(words), w)), lambda d: d.isNotNull()))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def cell_value(text: Column) -> Column:
    """(value, unit: percent or number) of a table cell: a number with %, or k, M or B, and a spread after ±; null for others, and where DECIMAL can't hold it."""
    value, mark = (F.trim(F.regexp_extract(text, CELL, g)) for g in (1, 2))
    scale = F.coalesce(F.try_element_at(_words_of({k: v for k, v in SCALES.items() if len(k) == 1}), F.lower(mark)), F.lit(1))
    scaled = _scaled(canonical(value), scale)
    return F.when((value != "") & scaled.isNotNull(), F.struct(scaled.alias("value"), F.when(mark == "%", "percent").otherwise("number").alias("unit")))


def _scaled(spelling: Column, scale: Column) -> Column:
    """A canonical number times a scale, exactly; null where it doesn't fit."""
    return F.when(scale == 1, exact_decimal(spelling)).otherwise((exact_decimal(spelling).try_cast("decimal(25,10)") * scale.cast("decimal(12,0)")).try_cast(DECIMAL))


def scaled_count(text: Column) -> Column:
    """A count in digits or a word up to twenty, and thousand, million or billion after it; null for others."""
    count, scale = (F.regexp_extract(F.lower(text), rf"^({NUMBER}|{'|'.join(CARDINALS)})(?: (thousand|million|billion))?$", g) for g in (1, 2))
    spelling = F.coalesce(F.try_element_at(_words_of(CARDINALS), count).cast("string"), F.when(count.rlike("^[+-]?[0-9]"), canonical(count)))
    return _scaled(spelling, F.coalesce(F.try_element_at(_words_of(SCALES), scale), F.lit(1)))


def reference_free(claim: Column) -> Column:
    """A claim without the numbers that name things: Table 3, Fig. 2, GPT-4, unless a percentage."""
    return F.regexp_replace(claim, NAMED_NUMBER, "")


def token_aligned(quote: Column, source: Column) -> Column:
    """How often a quote stands in a source without cutting a word or number at its ends; 0 for an empty quote."""
    literal = F.regexp_replace(quote, r"([\\^$.|?*+()\[\]{}\-])", r"\\$1")
    first, last = F.substring(quote, 1, 1), F.substring(quote, -1, 1)
    before = F.when(first.rlike("[0-9]"), r"(?<![\p{L}\p{N}+\-.,])").when(first.rlike(r"[\p{L}\p{N}]"), r"(?<![\p{L}\p{N}])").otherwise("")
    after = F.when(last.rlike("[0-9]"), r"(?![\p{L}\p{N}]|[.,]\d)").when(last.rlike(r"[\p{L}\p{N}]"), r"(?![\p{L}\p{N}])").otherwise("")
    return F.when(F.length(quote) > 0, F.regexp_count(source, F.concat(before, literal, after))).otherwise(0)


def bound(relation: Column, value: Column) -> Column:
    """(lo, lo_closed, hi, hi_closed) of eq, only, gt, ge, lt or le."""
    exact, above = relation.isin("eq", "only"), relation.isin("gt", "ge")
    return F.struct(F.when(exact | above, value).alias("lo"), (exact | (relation == "ge")).alias("lo_closed"), F.when(~above, value).alias("hi"), (exact | (relation == "le")).alias("hi_closed"))


def compare_bounds(asked: Column, seen: Column) -> Column:
    """true where the seen interval lies in the asked one, false where they don't meet, null between; a null end is open to infinity."""
    apart = lambda a, ac, b, bc: F.coalesce((a < b) | ((a == b) & ~(ac & bc)), F.lit(False))
    never = apart(seen["hi"], seen["hi_closed"], asked["lo"], asked["lo_closed"]) | apart(asked["hi"], asked["hi_closed"], seen["lo"], seen["lo_closed"])
    low = asked["lo"].isNull() | F.coalesce((seen["lo"] > asked["lo"]) | ((seen["lo"] == asked["lo"]) & (asked["lo_closed"] | ~seen["lo_closed"])), F.lit(False))
    high = asked["hi"].isNull() | F.coalesce((seen["hi"] < asked["hi"]) | ((seen["hi"] == asked["hi"]) & (asked["hi_closed"] | ~seen["hi_closed"])), F.lit(False))
    return F.when(never, False).when(low & high, True)


def names(text: Column) -> Column:
    """Words of a name or heading: key tokens with a scale's letter joined to its number, docs as documents and ood as out-of-domain."""
    words = key_tokens(F.regexp_replace(text, r"(?<=\d)\s+([BKM])\b", "$1"))
    return F.transform(words, lambda w: F.when(w == "docs", "documents").when(w == "ood", "out-of-domain").otherwise(w))


def evidence_numbers(text: Column) -> Column:
    """Distinct measured numbers, with % and without commas or blanks; numbers of tables, figures, sections and appendices are none."""
    found = F.regexp_extract_all(F.regexp_replace(text, NUMBERED_PLACE, ""), F.lit(MEASURED), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[,\s]", "")))


def quantifier(text: Column) -> Column:
    """all, some or none where a text has words of that kind alone, atomic where it has none, null where it mixes them."""
    kinds = {"all": r"(?i)\b(?:all|every|each)\b", "some": r"(?i)\b(?:some|at least one|one or more)\b", "none": r"(?i)\b(?:none|no)\b"}
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in kinds.items()]))
    return F.when(F.size(found) == 0, "atomic").when(F.size(found) == 1, F.get(found, F.lit(0)))


def split_claims(answer: Column) -> Column:
    """Claims of an answer: items of a list, cut after . ! ? before a blank and a capital, digit or quote; blank ones are none."""
    sections = F.split(F.trim(answer), LIST_ITEM)
    parts = F.flatten(F.transform(sections, lambda s: F.split(F.regexp_replace(s, ITEM_MARK, ""), SENTENCE_END)))
    return F.filter(F.transform(parts, F.trim), lambda p: p != "")


def clean_json(text: Column) -> Column:
    """What a fence holds, or else from the first brace to the last, or else the text."""
    fence = F.trim(F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)\s*```", 1))
    braces = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
    return F.when(text.rlike(r"```(?:json)?\s*[\s\S]*?\s*```"), fence).when(braces != "", braces).otherwise(F.trim(text))


def joined_lines(text: Column) -> Column:
    """A page's text without hyphens at line ends before small letters, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)(?<=\w)-[ \t]*\r?\n[ \t]*(?=[a-z])", ""), r"(?U)\s+", " "))


def compatible_units(claimed: Column, observed: Column) -> Column:
    """Whether a count's claimed words are, in order, among the observed ones, with one plural noun at the end; physical units must be equal."""
    left, right = F.split(F.trim(F.lower(claimed)), r"\s+"), F.split(F.trim(F.lower(observed)), r"\s+")
    last = F.element_at(left, -1)
    physical = F.array(*[F.lit(w) for w in "ms s seconds minutes hours days weeks months years liters meters grams watts".split()])
    met = F.aggregate(right, F.lit(0), lambda at, w: F.when((at < F.size(left)) & (F.get(left, at) == w), at + 1).otherwise(at))
    plain = last.endswith("s") & (last == F.element_at(right, -1))
    return F.when(~plain, False).when(F.array_contains(physical, last), F.lower(claimed) == F.lower(observed)).otherwise(met == F.size(left))
