"""Operator 6: personal data replaced by keyed surrogates, in DataFrame functions alone.

Entities (mail and network addresses, phone, card, bank and social security numbers, secrets, names after a title) are
found in whole texts by one pattern, which runs once: texts are written with what it finds. A number in a card's layout
whose check residue isn't a card's is no entity. Each distinct entity of a type gets one surrogate, made from a keyed hash:
digits become digits, letters letters of the same script and case, punctuation stays; a card keeps its first digit and its
check residue, a bank account its country and the residue of its check digits, a phone its country code or leading zero, a
mail address its top-level domain; an IPv6 address becomes one of eight groups; a given name becomes one of the same gender
and script, family names are built of syllables of the script (letter by letter in scripts without a list here).

Surrogates are unique within a type and never equal an entity of the corpus (names of all kinds are one type here, so that no
surrogate is another person's name): candidates are checked in rounds, and those that collide try again with the next attempt number; mail addresses and names grow with it. What is still without a
surrogate after ROUNDS attempts, as its layout is used up by the corpus itself, gets a tag of its type and a keyed hash. Mentions that differ in layout only ((555) 010-2000, 5550102000)
are one entity and each keeps its layout, so coreference survives within and across documents. A word of a name is one
entity wherever it stands: it is a given name if it comes before another word of a name in any mention, otherwise a family
name, and its gender is that of most of its titled mentions (neutral for a tie). Words joined by a hyphen are words of their
own with the hyphen between; particles (von, de) stay, the letters of initials are rotated in their alphabet by the key (they
are too few to be kept off other initials), and a word in capitals gets capitals. After a title, one or two words of a script
without case count as a name. Names that never follow a title, addresses and dates of birth are not looked for. Later mentions without a title are found
as well: capitalised words that are words of a titled name of the same text get its surrogate; they don't count as mentions
of their own.

Only mentions and the texts that hold any are shuffled. Defined results: null and empty texts stay and have no entity;
rows that agree in id and text get the same text; null ids are handled like any id; empty tables give empty tables; input
columns that clash with output names are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import materialize, table

from .components import join_facts

KEY = "corpusloom"
ROUNDS = 24
#: Titles by gender, given names by gender and script, syllables by script.
MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "г-н", "Г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "г-жа", "Г-жа")
NEUTRAL = ("Dr", "Prof")
GIVEN = {
    "LM": "Adam Bruno Carlos Daniel Emil Felix Georg Hugo Ivan Jonas Karl Louis Marco Noah Oscar Paul Ruben Simon Tomas Victor".split(),
    "LF": "Anna Berta Clara Diana Elena Flora Greta Helena Irene Julia Karla Laura Maria Nora Olga Paula Rosa Sofia Teresa Vera".split(),
    "LN": "Alex Andrea Charlie Dominique Jamie Kim Luca Morgan Noel Robin Sam Sascha Toni Uli".split(),
    "CM": "Алексей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег".split(),
    "CF": "Анна Вера Галина Дарья Елена Зоя Ирина Ксения Лидия Мария Нина Ольга".split(),
    "CN": "Женя Саша Валя Слава Шура Паша".split(),
    "GM": "Αλέξανδρος Βασίλης Γιώργος Δημήτρης Κώστας Λεωνίδας Μιχάλης Νίκος Πέτρος Σταύρος".split(),
    "GF": "Αγγελική Βασιλική Δέσποινα Ελένη Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χριστίνα".split(),
    "GN": "Άγγελος Κυριακή Φώτης Χαρά Ανέστης Δάφνη".split(),
}
SYLLABLES = {"G": "βα γε δι ζο θα κε λι μο να πε ρι σο τα φε χι ψα".split(), "L": "ba co de fi gu ha jo ke li mu na po re si tu va wo xe yi zu".split(), "C": "ба ве ги до жу за ка ле ми но пу ра се ти фо ху".split()}
ALPHABET = {"l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "c": "абвгдежзиклмнопрстуфхцчшщыэюя", "C": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЫЭЮЯ", "g": "αβγδεζηθικλμνξοπρστυφχψω", "G": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}
#: Letters with marks, by case, and the code points of letters of scripts without case (first and last).
MARKED = {"l": "àáâäçèéêëìíîïñòóôöùúûü", "u": "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"}
RANGES = {"IsHan": (0x4E00, 0x9FA5), "IsHangul": (0xAC00, 0xD7A3), "IsHiragana": (0x3042, 0x308F), "IsKatakana": (0x30A2, 0x30EF), "IsArabic": (0x0628, 0x063A), "IsHebrew": (0x05D0, 0x05EA), "IsDevanagari": (0x0915, 0x0939), "IsThai": (0x0E01, 0x0E2E)}
#: Words that follow Miss or Don as words, not as titles of names.
NO_NAME = "You|Your|The|This|That|It|Its|A|An|I|We|They|He|She|My|Our|All|No|Not|President|Chairman|Chairwoman|Speaker|Secretary|Minister|Universe|World|America|Right|Wrong"
PARTICLES = "von|vom|van|de|del|della|der|den|dem|di|da|du|la|le|los|las|zu|zur|zum|ten|ter|y|e|bin|ibn|al"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer around "::" with a digit among them (a::b alone is code).
_IP6 = rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]*\d)(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\w:]|\.\d)"
#: A word of a name goes on over hyphens and apostrophes, but not over a possessive or contracted ending.
_MORE = r"[\p{L}\p{M}]++(?:-\p{L}[\p{L}\p{M}]*+|['’](?!(?:s|ll|ve|re|d|m)(?!\p{L}))\p{L}[\p{L}\p{M}]*+)*+"
_WORD = rf"\p{{Lu}}(?:{_MORE}|(?:['’\-]\p{{L}}[\p{{L}}\p{{M}}]*+)++)"
#: Where a capitalised word of a name begins or ends in other text.
_EDGES = rf"(?<![\p{{L}}\p{{M}}\p{{N}}_])(?<![\p{{L}}\p{{M}}]['’])(?=\p{{Lu}})|(?<=[\p{{L}}\p{{M}}])(?![\p{{L}}\p{{M}}\p{{N}}_'’])|(?<=[\p{{L}}\p{{M}}])(?=['’](?:s|ll|ve|re|d|m)(?!\p{{L}}))|(?<=[\p{{L}}\p{{M}}])(?=['’\-]+(?!\p{{L}}))"
_INITIALS = r"\p{Lu}\.(?:-?\p{Lu}\.)*+"
_PARTICLES = rf"(?: (?:{PARTICLES}))*+"
#: A name of one or two words in a script without case.
_CASELESS = r"\p{Lo}[\p{Lo}\p{M}]*+(?: \p{Lo}[\p{Lo}\p{M}]*+)?+"
_TITLE = "|".join((*MALE, *FEMALE, *NEUTRAL))
#: A value that follows is a secret, whatever it looks like.
_ASSIGNED = r"(?i:password|passwd|pwd|secret|api[_\-]?key|access[_\-]?key|token) {0,2}[=:] {0,2}[\"']?"
PATTERNS = {
    "EMAIL": r"(?<![\p{L}0-9._%+\-])[\p{L}0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*(?<=\.[A-Za-z]{2,24})",
    "SECRET": r"(?<![A-Za-z0-9])(?:[A-Fa-f0-9]{32,}+|AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])"
    rf"|(?<=[=: \"'])(?<={_ASSIGNED})[A-Za-z0-9_+/=.~\-]{{6,}}+",
    "IBAN": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "IP": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)|{_IP6}",
    "PHONE": r"(?<![\w+])\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[\-. ]\d{4}(?!\d)|(?<![\d\-])\d{3}[\-.]\d{3}[\-.]\d{4}(?![\d\-])|(?<![\w.+\-/])0\d{2,4}[ /\-]\d{5,8}(?![\d\-])",
    "CARD": r"(?<![\d\-])\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?!\d)",
    "SSN": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    # The look-ahead comes first: a look-behind of many titles is dear, and capitals are few.
    "NAME": rf"(?=[\p{{Lu}}\p{{Lo}}])(?<=(?<!\p{{L}})(?:{_TITLE})\.? )(?!(?:{NO_NAME})(?!\p{{L}}))(?:{_CASELESS}|(?:{_WORD}|{_INITIALS}(?={_PARTICLES} \p{{Lu}}))(?:{_PARTICLES} (?:{_WORD}|{_INITIALS}|\p{{Lu}}(?= \p{{Lu}}\p{{L}})))*+)",
}
#: What a text with any entity holds: cheap to look for, so that the full pattern runs on few texts.
GATE = (r"[0-9]{2}|[0-9]\.[0-9]", r"[A-Fa-f0-9]{32}|gh[pousr]_|[A-Fa-f0-9]:[A-Fa-f0-9]{1,4}:", r"[A-Za-z] {0,2}[=:] {0,2}[\"']?[A-Za-z0-9_+/=.~\-]{6}", r"[MHFSDPГг](?:r|rs|s|iss|onsieur|adame|me|errn?|rau|eñora?|ra|on|oña|rof|-н|-жа)\.? [\p{Lu}\p{Lo}]")
SIGNS = ("@", "AKIA", "sk-", "::")
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _type(mention: Column, before: Column) -> Column:
    """The type of a mention, by its look and the end of the text before it, in the order of the patterns."""
    return (
        F.when(F.contains(mention, F.lit("@")), "EMAIL")
        .when(before.rlike(_ASSIGNED + "$"), "SECRET")
        .when(mention.rlike(r"^(?:[A-Fa-f0-9]{32,}|AKIA[A-Z0-9]{16}|gh[pousr]_\w+|sk-\w+)$"), "SECRET")
        .when(mention.rlike(r"^[A-Z]{2}\d"), "IBAN")
        .when(mention.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "IP")
        .when(mention.rlike("^[A-Fa-f0-9]*:"), "IP")
        .when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "SSN")
        .when(mention.rlike(r"^\+|^\(|^\d{3}[\-.]\d{3}[\-.]|^0\d{2,4}[ /\-]\d{5,8}$"), "PHONE")
        .when(mention.rlike(r"^\d"), "CARD")
        .otherwise("NAME")
    )


def _canonical(kind: Column, mention: Column) -> Column:
    """What mentions of one entity share: no layout, no case."""
    bare = F.regexp_replace(F.lower(mention), r"[ .()\-]", "")
    return F.when(kind.isin("PHONE", "CARD", "SSN"), F.regexp_replace(mention, r"\D", "")).when(kind == "IBAN", bare).when(kind == "SECRET", mention).otherwise(F.lower(mention))


def _stream(kind: Column, canon: Column, attempt: int, key: str) -> Column:
    """Keyed bytes as hexadecimal digits, two for each character of the entity and some more."""
    return F.array_join(F.transform(F.sequence(F.lit(0), (F.length(canon) / 60).cast("int")), lambda b: _block(kind, canon, attempt, key, b)), "")


def _block(kind: Column, canon: Column, attempt: int, key: str, b: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, F.lit(str(attempt)), b.cast("string")), 512)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(text: str, n: Column) -> Column:
    return F.substring(F.lit(text), (F.pmod(n, F.lit(len(text))) + 1).cast("int"), F.lit(1))


def _of_script(c: Column, n: Column) -> Column:
    """A letter of the same script for a letter beyond ASCII; what no script here knows stays a letter, of ASCII."""
    out = F.when(c.rlike(r"^\p{IsCyrillic}$"), F.when(c.rlike(r"^\p{Lu}$"), _pick(ALPHABET["C"], n)).otherwise(_pick(ALPHABET["c"], n)))
    out = out.when(c.rlike(r"^\p{IsGreek}$"), F.when(c.rlike(r"^\p{Lu}$"), _pick(ALPHABET["G"], n)).otherwise(_pick(ALPHABET["g"], n)))
    out = out.when(c.rlike(r"^\p{IsLatin}$"), F.when(c.rlike(r"^\p{Lu}$"), _pick(MARKED["u"], n)).otherwise(_pick(MARKED["l"], n)))
    for script, (first, last) in RANGES.items():
        code = F.lit(first) + F.pmod(n * 37, F.lit(last - first + 1))
        out = out.when(c.rlike(rf"^\p{{{script}}}$"), F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE"))
    return out.otherwise(_pick(ALPHABET["l"], n))


def _character(c: Column, n: Column, hexadecimal: Column) -> Column:
    return (
        F.when(c.rlike("^[0-9]$"), F.when(hexadecimal, _pick("0123456789abcdef", n)).otherwise(_pick("0123456789", n)))
        .when(hexadecimal & c.rlike("^[a-f]$"), _pick("0123456789abcdef", n))
        .when(c.rlike("^[A-Z]$"), _pick(ALPHABET["u"], n))
        .when(c.rlike("^[a-z]$"), _pick(ALPHABET["l"], n))
        .when(c.rlike(r"^\p{L}$"), _of_script(c, n))
        .otherwise(c)
    )


def _luhn(digits: Column) -> Column:
    """The check residue of a digit string."""
    parts = F.reverse(F.split(digits, ""))
    one = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.pmod(F.aggregate(F.transform(parts, one), F.lit(0), lambda a, x: a + x), F.lit(10))


def _mod97(account: Column) -> Column:
    """The check residue of a bank account: 1 for a valid one."""
    chars = F.split(F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4)), "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("^[0-9]$"), F.pmod(a * 10 + c.cast("int"), F.lit(97))).when(c != "", F.pmod(a * 100 + F.ascii(F.upper(c)) - 55, F.lit(97))).otherwise(a))


def _plain(kind: Column, canon: Column, fixed: Column, hexadecimal: Column, attempt: int, key: str) -> Column:
    """Each character by one of its kind; ``fixed`` leading characters stay as they are."""
    # Secrets have any length: each piece of 60 characters has its block; what blocks share is bound once by lists of one.
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    short = F.when(F.length(canon) <= 60, canon).otherwise(F.sha2(canon, 512))

    one = lambda p, block, b: F.array_join(F.transform(F.split(p, ""), lambda c, i: F.when(b * 60 + i < fixed, c).otherwise(_character(c, _byte(block, i), hexadecimal))), "")
    piece = lambda p, b, own: bound(_block(kind, own, attempt, key, b), lambda block: one(p, block, b))
    return bound(short, lambda own: F.array_join(F.transform(F.split(canon, r"(?<=\G[\s\S]{60})"), lambda p, b: piece(p, b, own)), ""))


def _surrogate(kind: Column, canon: Column, plain: Column, s: Column, attempt: int) -> Column:
    """The candidate of an entity, from its ``plain`` replacement and its stream ``s``."""
    last = F.pmod(F.substring(plain, -1, 1).cast("int") + _luhn(canon) - _luhn(plain), F.lit(10))
    card = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), last.cast("string"))
    body = F.substring(plain, F.lit(5), F.length(plain))
    check = F.pmod(_mod97(canon) - _mod97(F.concat(F.substring(plain, 1, 2), F.lit("00"), body)), F.lit(97))
    account = F.concat(F.substring(plain, 1, 2), F.lpad(F.when(check < 2, check + 97).otherwise(check).cast("string"), 2, "0"), body)
    top = F.regexp_extract(canon, r"\.[a-z]+$", 0)
    longer = F.array_join(F.array(*[_pick(ALPHABET["l"], _byte(s, F.lit(40 + i))) for i in range(attempt // 3)]), "") if attempt > 2 else F.lit("")
    mail = F.concat(longer, F.substring(plain, F.lit(1), F.length(plain) - F.length(top)), top)
    octets = F.transform(F.split(canon, r"\."), lambda o, i: (F.pmod(_byte(s, i), F.lit(254)) + 1).cast("string"))
    script = F.when(canon.rlike(r"^\p{IsCyrillic}"), "C").when(canon.rlike(r"^\p{IsGreek}"), "G").when(canon.rlike(r"^\p{IsLatin}"), "L")
    pool = F.lit(None)
    for name, values in GIVEN.items():
        first = _array(values)[F.pmod(_byte(s, F.lit(0)) * 256 + _byte(s, F.lit(1)), F.lit(len(values))).cast("int")]
        second = _array(values)[F.pmod(_byte(s, F.lit(2)) * 256 + _byte(s, F.lit(3)), F.lit(len(values))).cast("int")]
        # Pools are small: later attempts join two names, then add a middle syllable to their number.
        more = F.concat(first, F.lit("-"), second) if attempt else first
        if attempt > 2:
            more = F.concat(first, F.lit("-"), second, F.lit("-"), F.initcap(F.array_join(F.transform(F.sequence(F.lit(4), F.lit(4 + attempt // 2)), lambda i: _array(SYLLABLES[name[0]])[F.pmod(_byte(s, i), F.lit(len(SYLLABLES[name[0]]))).cast("int")]), "")))
        pool = F.when((script == name[0]) & (kind == f"GIVEN_{name[1]}"), more).otherwise(pool)
    family = F.lit(None)
    for name, values in SYLLABLES.items():
        parts = F.transform(F.sequence(F.lit(0), F.lit(2 + attempt // 4)), lambda i: _array(values)[F.pmod(_byte(s, i), F.lit(len(values))).cast("int")])
        family = F.when(script == name, F.initcap(F.array_join(parts, ""))).otherwise(family)
    groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(F.lit("2"), F.substring(s, (i * 3 + 1).cast("int"), F.lit(3)))), ":")
    return F.when(kind == "IP", F.array_join(octets, ".")).when(kind == "IP6", groups).when(kind == "CARD", card).when(kind == "IBAN", account).when(kind == "EMAIL", mail).when(kind == "FAMILY", F.coalesce(family, F.initcap(plain))).when(kind.startswith("GIVEN"), F.coalesce(pool, F.initcap(plain))).otherwise(plain)


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon, fixed): unique within a kind, all names together, and no entity of the corpus."""
    space = F.when(F.col("kind").startswith("GIVEN") | (F.col("kind") == "FAMILY"), "NAME").otherwise(F.col("kind")).alias("space")
    waiting = materialize(entities, "entities")
    real = waiting.select(space, F.lower("canon").alias("low"))
    settled = None
    for attempt in range(ROUNDS):
        # Columns of their own, as an expression that is used again and again makes plans too large for the driver.
        kind, canon = F.col("kind"), F.col("canon")
        tried = waiting.withColumn("hexa", (kind == "SECRET") & canon.rlike("^[a-f0-9]+$")).withColumn("stream", _stream(kind, canon, attempt, key))
        tried = tried.withColumn("plain", _plain(kind, canon, F.col("fixed"), F.col("hexa"), attempt, key))
        tried = tried.withColumn("surrogate", _surrogate(kind, canon, F.col("plain"), F.col("stream"), attempt)).withColumn("low", F.lower("surrogate"))
        taken = real if settled is None else real.union(settled.select(space, F.lower("surrogate").alias("low")))
        free = tried.select("*", space).join(taken, ["space", "low"], "left_anti")
        first = free.groupBy("space", "low").agg(F.min(F.struct("canon", "kind", "surrogate")).alias("w"))
        won = materialize(first.select(F.col("w.kind").alias("kind"), F.col("w.canon").alias("canon"), F.col("w.surrogate").alias("surrogate")), "assigned")
        settled = won if settled is None else settled.union(won)
        waiting = materialize(waiting.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"), "waiting")
        if waiting.isEmpty():
            return settled
    tag = F.concat(F.lit("["), "kind", F.lit(" "), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "canon"), 256), 1, 24), F.lit("]"))
    return settled.union(waiting.select("kind", "canon", tag.alias("surrogate")))


def _laid_out(mention: Column, surrogate: Column, kind: Column) -> Column:
    """The surrogate in the layout of the mention: digits and letters fill the places of the mention's."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda a, c: F.when(c.rlike(r"^[A-Za-z0-9]$"), F.struct(F.concat(a["out"], F.substring(surrogate, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at")))
    filled = F.aggregate(F.split(mention, ""), start, step)["out"]
    filled = F.when(kind == "IBAN", F.upper(filled)).otherwise(filled)
    cased = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(surrogate)).otherwise(surrogate)
    cased = F.when(F.length(mention) > 1, cased).otherwise(surrogate)
    return F.when(surrogate.startswith("["), surrogate).when(kind.isin("PHONE", "CARD", "SSN", "IBAN"), filled).when(kind.isin("EMAIL", "NAME"), cased).otherwise(surrogate)


def _initials(part: Column, key: str) -> Column:
    """Initials with each letter moved on in its alphabet, as far as the key says: two stay two."""
    out = part
    for letters in (ALPHABET["u"], ALPHABET["C"], ALPHABET["G"]):
        far = int(hashlib.sha256(f"{key}{letters}".encode()).hexdigest(), 16) % (len(letters) - 1) + 1
        out = F.translate(out, letters, letters[far:] + letters[:far])
    return out


def surrogate_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text_col``, n_entities (mentions) and entity_types (sorted, distinct)."""
    own = ("n_entities", "entity_types")
    columns = [c for c in docs.columns if c not in own and c != text_col]
    base = docs.select(F.struct(F.lit(0).alias("__"), *columns).alias("__doc"), F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__key"), F.col(text_col).alias("__text"))
    gate = functools.reduce(operator.or_, [*(F.contains("__text", F.lit(x)) for x in SIGNS), *(F.col("__text").rlike(x) for x in GATE)])
    base = base.withColumn("found", F.when(gate, F.regexp_extract_all("__text", F.lit(ANY), F.lit(0))))
    base = materialize(base.withColumn("gaps", F.when(F.size("found") > 0, F.split("__text", ANY, -1))), "found")
    some = F.coalesce(F.size("found") > 0, F.lit(False))
    having, lacking = base.where(some), base.where(~some)
    split = having.select("__id", "__key", "found", F.transform("gaps", lambda g: F.substring(g, -24, 24)).alias("ends"))
    title = F.element_at("ends", F.col("pos") + 1)
    mentions = split.select("__id", "__key", "ends", F.posexplode("found").alias("pos", "mention")).withColumn("type", _type(F.col("mention"), title))
    digits = F.regexp_replace("mention", r"\D", "")
    # What only looks like a card stays where it is, as a mention without a type.
    mentions = mentions.withColumn("type", F.when((F.col("type") != "CARD") | ((F.length(digits) >= 13) & (_luhn(digits) == 0)), F.col("type")))
    gender = F.when(title.rlike(rf"(?:{'|'.join(FEMALE)})\.? $"), "F").when(title.rlike(rf"(?:{'|'.join(MALE)})\.? $"), "M").otherwise("N")
    # Names go word by word, what a hyphen joins too; each part keeps what stood before it.
    pieces = lambda w, i: F.transform(F.split(w, "-"), lambda p, j: F.struct(p.alias("part"), F.when(j > 0, "-").when(i > 0, " ").otherwise("").alias("sep"), i.alias("word")))
    words = F.when(F.col("type") == "NAME", F.split("mention", " ")).otherwise(F.array("mention"))
    whole = F.transform(words, lambda w, i: F.array(F.struct(w.alias("part"), F.lit("").alias("sep"), i.alias("word"))))
    split_ = F.when(F.col("type") == "NAME", F.transform(words, pieces)).otherwise(whole)
    parts = mentions.select("__id", "__key", "pos", "type", gender.alias("gender"), F.size(words).alias("many"), F.posexplode(F.flatten(split_)).alias("sub", "p"))
    parts = parts.select("__id", "__key", "pos", "type", "gender", "many", "sub", "p.part", "p.sep", "p.word")
    # Parts of a name that are no entity of their own.
    initial = (F.col("type") == "NAME") & F.col("part").rlike(r"^(?:\p{Lu}\.)+$|^\p{Lu}$")
    aside = F.coalesce((F.col("type") == "NAME") & F.col("part").rlike(rf"^(?:{PARTICLES})$") | initial, F.lit(False))
    parts = parts.withColumn("aside", aside)
    kind = F.when((F.col("type") == "IP") & F.contains("part", F.lit(":")), "IP6").otherwise(F.col("type"))
    parts = parts.withColumn("kind", kind).withColumn("canon", _canonical(F.col("kind"), F.col("part")))
    # Leading characters that stay: a card's issuer digit, an international number's country code, a bank account's country, a key's prefix.
    country = F.length(F.regexp_extract("part", r"^\+(\d{1,3})(?:[ .(\-]|$)", 1))
    fixed = F.when(F.col("kind") == "CARD", 1).when((F.col("kind") == "PHONE") & F.col("part").startswith("0"), 1).when(F.col("kind") == "PHONE", country).when(F.col("kind") == "IBAN", 2).when(F.col("part").startswith("AKIA") | F.col("part").rlike("^gh[pousr]_"), 4).when(F.col("part").startswith("sk-"), 3).otherwise(0)
    given = F.col("word") < F.col("many") - 1
    parts = materialize(parts.select("__id", "__key", "pos", "sub", "sep", "type", "kind", "part", "aside", "canon", "gender", given.alias("given"), fixed.alias("fixed")), "mentions")
    lean = F.sum(F.when(F.col("gender") == "F", 1).when(F.col("gender") == "M", -1).otherwise(0))
    entity = F.concat_ws("\x1f", "kind", "canon")
    own_parts = parts.where("type is not null and not aside")
    entities = own_parts.groupBy("kind", "canon").agg(F.max("fixed").alias("fixed"), F.max("given").alias("given"), lean.alias("lean"), F.count("*").alias("rows"))
    entities = materialize(entities, "entities")
    settled = F.when(F.col("kind") != "NAME", F.col("kind")).when(~F.col("given"), "FAMILY").when(F.col("lean") > 0, "GIVEN_F").when(F.col("lean") < 0, "GIVEN_M").otherwise("GIVEN_N")
    assigned = assign(entities.select(settled.alias("kind"), "canon", "fixed"), key)
    assigned = assigned.withColumn("kind", F.when(F.col("kind").startswith("GIVEN") | (F.col("kind") == "FAMILY"), "NAME").otherwise(F.col("kind")))
    assigned = materialize(assigned.join(entities.select("kind", "canon", "rows"), ["kind", "canon"]).select(entity.alias("entity"), "rows", "surrogate"), "assigned")
    named = join_facts(own_parts.withColumn("entity", entity), assigned, "entity", "rows", "inner")
    rest = parts.where("type is null or aside").withColumn("surrogate", F.when(F.col("aside") & F.col("part").rlike(r"^\p{Lu}"), _initials(F.col("part"), key)).otherwise(F.col("part")))
    named = named.unionByName(rest, allowMissingColumns=True)
    put = named.select("__id", "__key", "pos", "sub", "sep", "type", F.when(F.col("type").isNull() | F.col("aside"), F.col("surrogate")).otherwise(_laid_out(F.col("part"), F.col("surrogate"), F.col("kind"))).alias("put"), F.when(F.col("type") == "NAME", F.col("part")).alias("name"))
    # A set, as rows that repeat with id and text bring each mention again; a text's mentions stay together.
    # Initials and particles aren't looked for without a title.
    word = F.when(F.col("name").rlike(r"^\p{Lu}[\p{L}\p{M}'’\-]+$"), F.struct(F.col("name").alias("key"), F.col("put").alias("value")))
    puts = put.groupBy("__id", "__key").agg(F.array_sort(F.collect_set(F.struct("pos", "sub", "put", F.col("type").isNotNull().alias("is"), "sep"))).alias("puts"), F.array_sort(F.collect_set("type")).alias("types"), F.map_from_entries(F.collect_set(word)).alias("names"))
    puts = puts.withColumnsRenamed({"__id": "i", "__key": "k"})
    joined = having.join(puts, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__key") == F.col("k")))
    # Words of names in the gaps: what lies between words stays.
    repeat = lambda w: F.coalesce(F.col("names")[w], w)
    known = lambda g: F.array_join(F.transform(F.split(g, _EDGES), repeat), "")
    gaps = F.when(F.size("names") > 0, F.transform("gaps", known)).otherwise(F.col("gaps"))
    piece = lambda p: F.concat(F.when(p["sub"] > 0, p["sep"]).otherwise(F.element_at(F.col("__gaps"), p["pos"] + 1)), p["put"])
    text = F.concat(F.array_join(F.transform("puts", piece), ""), F.element_at("__gaps", -1))
    done = joined.withColumn("__gaps", gaps).select("__doc", text.alias("__text"), F.size(F.filter("puts", lambda p: (p["sub"] == 0) & p["is"])).alias("n_entities"), F.col("types").alias("entity_types"))
    rest = lacking.select("__doc", "__text", F.lit(0).alias("n_entities"), F.array().cast("array<string>").alias("entity_types"))
    return done.union(rest).select(*[(F.col("__text") if c == text_col else F.col("__doc")[c]).alias(c) for c in docs.columns if c not in own], "n_entities", "entity_types")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_pii": op6_pii}
SQL: dict[str, str] = {}
