"""Personal data replaced by surrogates, in DataFrame and SQL functions only.

Detected entities: e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, card, account and social security
numbers, IBANs, credentials, and personal names after a title. Each entity gets a surrogate of its own type, drawn from a
hash under a secret key that the caller gives: separators and lengths stay, digits become digits, letters letters of their
case and script, a card keeps its network digit and its Luhn remainder, an IBAN its country and gets right check digits, a
telephone number its country code, an address its private range, a name its gender, script and parts.

Mentions that differ only in case or separators are one entity and get one surrogate everywhere (coreference). Each part of a
name is an entity, so a surname alone and with a given name agree, whatever the titles. What is known of a part comes from
all its mentions: it is a given name if it stands before other parts at least as often as last, and has the gender of the
titles it stands after; where titles differ or say nothing (Dr) the surrogate is a name for any gender. Distinct entities get
distinct surrogates, and no surrogate is a value that occurs under any type: who draws a taken one draws again. Names grow
by a syllable with the rounds and addresses leave a full private range, so that rounds end; from round ``RELAXED`` on a
surrogate may be a value that occurs (of a type so full that hardly any other is left), and is still distinct. Initials
are mapped letter by letter and may coincide.

Only texts with an entity are dealt; the table of distinct entities is joined and never collected. Entities and texts that
hold more than a ten-thousandth of the rows are joined by a broadcast, so that no task gets them all; there are at most ten
thousand of them.

Edge cases: null and empty texts stay as they are; very long texts are replaced whole; equal texts are searched once;
repeated rows and null ids are kept; texts without entities come out byte for byte; an empty table gives an empty table;
further columns are kept (one named pii_entities is replaced).
"""

from __future__ import annotations

import functools
import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import forget, written

RELAXED, ROUNDS = 16, 64
_HOT_SHARE, _HOT_ROWS, _HOT_CHARS = 10_000, 50_000, 4_096

_MALE, _FEMALE, _ANY = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "Κύριος", "κ."), ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Sra", "г-жа", "Κυρία", "κα"), ("Dr", "Prof")
_TITLES = "|".join(x.replace(".", r"\.") for x in sorted((*_MALE, *_FEMALE, *_ANY), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: One part of a name (O'Brien is one, a genitive 's is none), and a part or an initial.
_PART = r"\p{Lu}(?:\p{L}++|(?=['’]\p{L}{2}))(?:['’]\p{L}{2,}+)*+"
_TOKEN = rf"{_PART}|\p{{Lu}}\."
#: In the order in which they are tried at a place of the text. What has no length by its nature has no upper bound here.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}.-]*[\p{L}\p{N}-]\.\p{L}{2,}+(?![\p{L}\p{N}])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16,}+|gh[pousr]_[A-Za-z0-9_]{20,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])"
    r"|(?<=[=:\s\"'])(?<=(?i:password|passwd|secret|token|api[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9+/_.~-]{7,}[A-Za-z0-9+/_~-]=*+",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)|(?<![0-9A-Za-z:.])(?:{_HEX}:){{7}}{_HEX}(?![0-9A-Za-z:])"
    rf"|(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*\d)(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?(?:(?:\.\d{{1,3}}){{3}})?(?![0-9A-Za-z:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,6}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![\d-]|\.\d)",
    "card": r"(?<![\d.])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES})\.?[ \t]+(?:\p{{Lu}}\.[ -]?)*+{_PART}(?:[ -](?:{_TOKEN}))*+",
}
PATTERN = "|".join(PATTERNS.values())
#: Met by every text in which ``PATTERN`` finds something: a part, without bounds, of each way to match.
MAYBE = rf"[@]|\d{{3}}|\d\.\d|[0-9A-Fa-f]:[0-9A-Fa-f]|::|[A-Z]{{2}}\d{{2}}|\+\d|AKIA|gh[pousr]_|sk-|xox[abprs]-|[0-9a-f]{{32}}|[0-9A-F]{{32}}|[=:]\s{{0,2}}[\"']?[A-Za-z0-9+/_.~-]{{8}}|(?:{_TITLES})\.?[ \t]"

#: Names of the first round, by script (l: Latin, c: Cyrillic, g: Greek) and gender (n: any); later rounds build them of syllables.
_GIVEN = {
    "lm": "James Robert Michael David Thomas Daniel Paul Andrew Peter Henry Martin Lukas Felix Jonas Karl Pierre Louis Hugo Carlos Diego Pablo Javier Mateo Oscar Victor Leon Simon Walter Edgar Bruno".split(),
    "lf": "Mary Linda Susan Karen Laura Emma Alice Julia Clara Helen Anna Lena Sophie Marie Greta Chloe Camille Lucia Elena Carmen Isabel Rosa Ines Nora Olivia Edith Irene Paula Teresa Vera".split(),
    "ln": "Alex Robin Kim Jamie Taylor Morgan Casey Jordan Riley Avery Quinn Rowan Charlie Sidney Ariel".split(),
    "cm": "Иван Пётр Сергей Андрей Николай Павел Михаил Олег Виктор Борис".split(),
    "cf": "Анна Мария Ольга Елена Ирина Нина Вера Татьяна Лидия Софья".split(),
    "cn": "Саша Женя Валя Шура Слава".split(),
    "gm": "Νίκος Γιώργος Κώστας Δημήτρης Πέτρος Παύλος Ανδρέας Σπύρος".split(),
    "gf": "Μαρία Ελένη Άννα Σοφία Κατερίνα Δήμητρα Βασιλική Ειρήνη".split(),
    "gn": "Αρτέμι Χριστί Φωτί Χαρί".split(),
}
_SYLLABLES = {
    "l": "bar ben cor dal den fel gar hol ker lan mar mel nor pol ren sal tor ver wil zan".split(),
    "c": "бар бел вол гор дан зер кол лен мор нов пол рад сел тур фед".split(),
    "g": "βασ γερ δημ ζαχ θαν καλ λαμ μαν νικ παπ ραφ σταμ τσαλ φιλ χαρ".split(),
}
#: Endings of built names, by script and gender (s, t: surnames, the second of those that end like a woman's).
_ENDINGS = {
    "lm": "on us er an en ik".split(), "lf": "a ia ina elle ine ette".split(), "ln": "y is in el".split(), "ls": "man sen ley ton der berg".split(), "lt": "man sen ley ton der berg".split(),
    "cm": "ан ил ей он им ар".split(), "cf": "ия ина ея она ана".split(), "cn": "ша ня ля".split(), "cs": "ов ев ин".split(), "ct": "ова ева ина".split(),
    "gm": "ος ης ας".split(), "gf": "α η ία".split(), "gn": "ι ω".split(), "gs": "ίδης όπουλος άκης".split(), "gt": "ίδου οπούλου άκη".split(),
}
_LETTERS = {"l": "abcdefghijklmnopqrstuvwxyz", "c": "абвгдежзиклмнопрстуфхцчшэюя", "g": "αβγδεζηθικλμνξοπρστυφχψω"}


def _script(value: str) -> str:
    """SQL for the script of a value: c, g or l."""
    return f"case when {value} rlike '[\\\\u0400-\\\\u04FF]' then 'c' when {value} rlike '[\\\\u0370-\\\\u03FF\\\\u1F00-\\\\u1FFF]' then 'g' else 'l' end"


def kind(mention: Column) -> Column:
    """The type of a mention: the first pattern that matches it whole (with what may stand before it)."""
    out = F.when(mention.rlike(f"^(?:{_TITLES})\\.?[ \\t]+\\p{{Lu}}"), "name")
    for name in ("email", "ip", "iban", "ssn", "phone", "card"):
        out = out.when(mention.rlike(f"^(?:{PATTERNS[name]})$"), name)
    return out.otherwise("secret")


def _untitled(mention: Column) -> Column:
    return F.regexp_replace(mention, f"^(?:{_TITLES})\\.?[ \\t]+", "")


def entities(mention: Column) -> Column:
    """Entities of a mention: an array of (type, value, place, gender), value being the form that all its mentions share."""
    what = kind(mention)
    title = F.regexp_extract(mention, f"^({_TITLES})", 1)
    gender = F.when(title.isin(*_MALE), "m").when(title.isin(*_FEMALE), "f")
    none = F.lit(None).cast("string")

    def named(parts: Column) -> Column:
        whole = F.size(F.filter(parts, lambda p: ~p.endswith(".")))

        def part(p: Column, i: Column, counts: Column) -> Column:
            early = i < counts["parts"] - 1
            place = F.when(early, "given").when(counts["whole"] > 1, "last").otherwise("only")
            return F.struct(F.when(p.endswith("."), "initial").otherwise("name").alias("type"), F.lower(p).alias("value"), place.alias("place"), F.when(early, gender).alias("gender"))

        once = F.array(F.struct(F.size(parts).alias("parts"), whole.alias("whole")))  # a variable of a lambda is worked out once
        return F.element_at(F.transform(once, lambda counts: F.transform(parts, lambda p, i: part(p, i, counts))), 1)

    parts = F.regexp_extract_all(_untitled(mention), F.lit(_TOKEN), F.lit(0))
    digits = F.regexp_replace(mention, r"[^0-9+]", "")
    value = F.when(what.isin("email", "ip"), F.lower(mention)).when(what.isin("phone", "card", "ssn"), digits).when(what == "iban", F.replace(mention, F.lit(" "), F.lit(""))).otherwise(mention)
    return F.when(what == "name", F.element_at(F.transform(F.array(parts), named), 1)).otherwise(F.array(F.struct(what.alias("type"), value.alias("value"), none.alias("place"), none.alias("gender"))))


@functools.cache
def _random_key() -> str:
    return secrets.token_hex(32)


def key_of(spark: SparkSession) -> str:
    """The secret key that the session names in ``spark.lattica.surrogates.key``; where it is unset, a random one of this process.

    Surrogates agree between runs only under a key that is set."""
    return spark.conf.get("spark.lattica.surrogates.key", None) or _random_key()


def _secret(key: str) -> str:
    """The key as it goes into hashes: of fixed length, and safe inside SQL."""
    return hashlib.sha256(key.encode()).hexdigest()


def _draw(key: str) -> str:
    """SQL for the surrogate of (kind, value) at a given attempt."""
    at = "cast(pmod(xxhash64(h, i), 1000003) as int)"
    script = _script("value")

    def pick(text: str) -> str:
        return f"substr({text}, 1 + v % length({text}), 1)"

    def choose(words: list[str], index: str) -> str:
        return f"element_at(array({', '.join(f"'{w}'" for w in words)}), 1 + {index} % {len(words)})"

    def by_script(make) -> str:
        return f"case {script} when 'c' then {make('c')} when 'g' then {make('g')} else {make('l')} end"

    letter = f"case {_script('c')} " + " ".join(f"when '{s}' then {pick(f"'{x}'")}" for s, x in _LETTERS.items()) + " end"
    char = f"""
        case when c rlike '[0-9]' then case
               when kind = 'phone' and f.plus and i <= 1 then c
               when kind = 'card' and i = 0 then c
               when i = 0 or (kind = 'phone' and i <= 2) then {pick("'23456789'")}
               else {pick("'0123456789'")} end
             when kind = 'iban' and i < 2 then c
             when kind = 'email' and i >= f.top then c
             when kind = 'secret' and f.lower then {pick("'abcdef'")}
             when kind = 'secret' and f.upper then {pick("'ABCDEF'")}
             when kind = 'secret' and i < f.prefix then c
             when kind = 'ip' and c rlike '[a-f]' then {pick("'abcdef'")}
             when c rlike '\\\\p{{Lu}}' then upper({letter})
             when c rlike '\\\\p{{L}}' then {letter}
             else c end"""
    facts = """named_struct('plus', value like '+%', 'top', length(value) - length(substring_index(value, '.', -1)), 'lower', value rlike '^[0-9a-f]+$', 'upper', value rlike '^[0-9A-F]+$',
        'prefix', length(regexp_extract(value, '^(AKIA|gh[pousr]_|sk-|xox[abprs]-)', 1)))"""
    mapped = f"element_at(transform(array({facts}), f -> array_join(transform(filter(split(value, ''), c -> c <> ''), (c, i) -> element_at(transform(array({at}), v -> {char}), 1)), '')), 1)"
    # of the ten digits that can come last, the one that gives the Luhn remainder of the value
    luhn = "aggregate(sequence(1, length({0})), 0, (t, p) -> t + if((length({0}) - p) % 2 = 1, element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), 1 + cast(substr({0}, p, 1) as int)), cast(substr({0}, p, 1) as int)))"
    card = f"element_at(transform(array({mapped}), m -> element_at(filter(transform(sequence(0, 9), d -> concat(left(m, length(m) - 1), d)), x -> {luhn.format('x')} % 10 = {luhn.format('value')} % 10), 1)), 1)"
    # letters count from 10, country and 00 come last, and the remainder modulo 97 is taken from 98
    rest = "aggregate(filter(split(concat(substr(m, 5), left(m, 2), '00'), ''), c -> c <> ''), 0, (r, c) -> if(c rlike '[0-9]', (r * 10 + cast(c as int)) % 97, (r * 100 + ascii(c) - 55) % 97))"
    iban = f"element_at(transform(array({mapped}), m -> concat(left(m, 2), lpad(cast(98 - {rest} as string), 2, '0'), substr(m, 5))), 1)"
    kept = "value rlike '^192\\\\.168\\\\.' and attempt < 8"
    middle = "value rlike '^172\\\\.(1[6-9]|2\\\\d|3[01])\\\\.' and attempt < 8"
    private = "value rlike '^(192\\\\.168|172\\\\.(1[6-9]|2\\\\d|3[01]))\\\\.'"
    octets = f"array_join(transform(split(value, '\\\\.'), (o, i) -> case when i = 0 and o in ('10', '127') then o when i < 2 and {kept} then o when i = 0 and {middle} then o when i = 1 and {middle} then cast(16 + {at} % 16 as string) when i = 0 and {private} then '10' when i = 0 then cast(11 + {at} % 110 as string) else cast(1 + {at} % 254 as string) end), '.')"
    index = "cast(pmod(xxhash64(h, {0}), 1000003) as int)"

    def built(end: str, shortest: int) -> str:
        return by_script(lambda s: f"initcap(concat(array_join(transform(sequence(1, {shortest} + cast(attempt div 2 as int)), i -> {choose(_SYLLABLES[s], at)}), ''), {choose(_ENDINGS[s + end], index.format(0))}))")

    given = "case kind " + " ".join(f"when 'given_{g}' then if(attempt = 0, {by_script(lambda s, g=g: choose(_GIVEN[s + g], index.format(0)))}, {built(g, 1)})" for g in "mfn") + " end"
    surname = f"if(value rlike '[ая]$|ου$|[αη]$', {built('t', 2)}, {built('s', 2)})"
    stream = f"sha2(concat_ws('|', '{_secret(key)}', kind, value, attempt), 512)"
    return f"element_at(transform(array({stream}), h -> case when kind = 'ip' and value like '%.%' and value not like '%:%' then {octets} when kind = 'card' then {card} when kind = 'iban' then {iban} when kind like 'given%' then {given} when kind = 'surname' then {surname} else {mapped} end), 1)"


def known(found: DataFrame) -> DataFrame:
    """(type, value, kind, n) of the distinct entities of ``found`` (type, value, place, gender): what all mentions say together."""
    def times(which: Column) -> Column:
        return F.sum(F.when(which, 1).otherwise(0))

    counted = found.groupBy("type", "value").agg(
        F.count("*").alias("n"), times(F.col("place") == "given").alias("given"), times(F.col("place") == "last").alias("last"), times(F.col("gender") == "m").alias("m"), times(F.col("gender") == "f").alias("f")
    )
    gender = F.when((F.col("m") > 0) & (F.col("f") == 0), "m").when((F.col("f") > 0) & (F.col("m") == 0), "f").otherwise("n")
    role = F.when((F.col("given") > 0) & (F.col("given") >= F.col("last")), F.concat(F.lit("given_"), gender)).otherwise("surname")
    return counted.select("type", "value", F.when(F.col("type") == "name", role).otherwise(F.col("type")).alias("kind"), "n")


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(type, value, n, surrogate) for the rows of ``found`` (type, value, kind, n), distinct in (type, value).

    Surrogates are distinct over all types, and no value that occurs. Of those that draw the same one the first by hash
    gets it; the others, and whoever drew a value, draw again."""
    values = found.select(F.lower("value").alias("s"))
    pending, settled = found, []
    for attempt in range(ROUNDS):
        drawn = written(pending.withColumn("attempt", F.lit(attempt)).withColumn("surrogate", F.expr(_draw(key))), "drawn")
        first = drawn.groupBy(F.lower("surrogate").alias("s")).agg(F.min(F.struct(F.xxhash64("kind", "value").alias("h"), "type", "value", "n", "surrogate")).alias("w"))
        for taken in [values] * (attempt < RELAXED) + [x.select(F.lower("surrogate").alias("s")) for x in settled]:
            first = first.join(taken, "s", "left_anti")
        settled.append(written(first.select("w.type", "w.value", "w.n", "w.surrogate"), "settled"))
        rest = written(drawn.join(settled[-1], ["type", "value"], "left_anti").select("type", "value", "kind", "n"), "pending")
        forget(drawn, *([pending] if attempt else []))
        pending = rest
        if pending.isEmpty():
            out = settled[0]
            for more in settled[1:]:
                out = out.unionByName(more)
            return out
    raise ValueError(f"no free surrogate after {ROUNDS} rounds: more values of one format than the format has")


def _initial(key: str) -> str:
    """SQL for the surrogate of an initial, a letter of its script and the full stop."""
    draw = f"cast(pmod(xxhash64(sha2(concat('{_secret(key)}', value), 512)), 1000003) as int)"
    return f"concat(upper(case {_script('value')} " + " ".join(f"when '{s}' then substr('{x}', 1 + {draw} % {len(x)}, 1)" for s, x in _LETTERS.items()) + " end), '.')"


def fill(mention: Column, parts: Column) -> Column:
    """A mention with its characters taken from the surrogates ``parts`` of its entities, in its own separators and case."""
    token = _TOKEN.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(
        """case
             when {m} rlike '^(?:TITLES)\\\\.?[ \\\\t]+\\\\p{Lu}' then concat(
               regexp_extract({m}, '^((?:TITLES)\\\\.?[ \\\\t]+)', 1),
               element_at(transform(array(regexp_replace({m}, '^(?:TITLES)\\\\.?[ \\\\t]+', '')), own ->
                 array_join(transform(arrays_zip(split(own, 'TOKEN', -1), regexp_extract_all(own, 'TOKEN', 0), transform({p}, s -> s)), x ->
                   concat(x['0'], case when x['2'] is null then '' when x['1'] rlike '^\\\\p{Lu}{2,}$' then upper(x['2']) else x['2'] end)), '')), 1))
             when {m} rlike '^[0-9.]+$' and {m} like '%.%.%.%' then {p}[0]
             when length({m}) = length({p}[0]) then array_join(transform(arrays_zip(split({m}, ''), split({p}[0], '')), x -> if(x['0'] rlike '\\\\p{Lu}', upper(x['1']), x['1'])), '')
             else element_at(transform(array(regexp_replace({p}[0], '[^\\\\p{L}\\\\p{N}]', '')), plain ->
               array_join(transform(filter(split({m}, ''), c -> c <> ''), (c, i) ->
                 if(c rlike '[\\\\p{L}\\\\p{N}]',
                    element_at(transform(array(substr(plain, length(regexp_replace(left({m}, i + 1), '[^\\\\p{L}\\\\p{N}]', '')), 1)), s ->
                      if(c rlike '\\\\p{Lu}', upper(s), s)), 1),
                    c)), '')), 1)
           end""".replace("TITLES", _TITLES.replace("\\", "\\\\")).replace("TOKEN", token).replace("{m}", mention).replace("{p}", parts)
    )


def _joined(rows: DataFrame, given: DataFrame, on: list[str], hot: DataFrame | None, how: str) -> DataFrame:
    """``rows`` joined with ``given``; those of the bounded table ``hot`` of frequent keys by a broadcast."""
    if hot is None:
        return rows.join(given, on, how)
    marked = rows.join(F.broadcast(hot.select(*on, F.lit(True).alias("__hot"))), on, "left")
    often = marked.where("__hot").drop("__hot").join(F.broadcast(given.join(F.broadcast(hot.select(*on)), on, "left_semi")), on)
    return often.unionByName(marked.where("__hot is null").drop("__hot").join(given, on, how))


def _hot(counted: DataFrame) -> DataFrame | None:
    """Rows of ``counted`` whose ``n`` is over a ten-thousandth of all, ten thousand rows at most; None if there are none."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = counted.where(F.col("n") > max(_HOT_ROWS, total // _HOT_SHARE))
    return None if hot.isEmpty() else hot


def replaced(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text`` under the secret ``key``, and a column ``pii_entities``: mentions replaced."""
    columns = [c for c in docs.columns if c != "pii_entities"]
    maybe = F.coalesce(F.col(text).rlike(MAYBE), F.lit(False))
    sha = F.sha2(F.col(text), 256)
    hits = docs.where(maybe).select(sha.alias("sha"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("mentions")).where("size(mentions) > 0")
    mentions = written(hits.groupBy("sha").agg(F.first("mentions").alias("mentions"), F.count("*").alias("n")), "mentions")
    each = mentions.select("sha", F.posexplode("mentions").alias("pos", "mention")).withColumn("entities", entities(F.col("mention")))
    split = written(each.select("sha", "pos", "mention", F.posexplode("entities").alias("part", "e")).select("sha", "pos", F.when(F.col("part") == 0, F.col("mention")).alias("mention"), "part", "e.*"), "entities")
    distinct = written(known(split.where("type <> 'initial'")), "distinct")
    given = surrogates(distinct, key)
    often = _hot(distinct)
    named = _joined(split.where("type <> 'initial'"), given.drop("n"), ["type", "value"], often, "inner").select("sha", "pos", "mention", "part", "surrogate")
    joined = named.unionByName(split.where("type = 'initial'").select("sha", "pos", "mention", "part", F.expr(_initial(key)).alias("surrogate")))
    parts = joined.groupBy("sha", "pos").agg(F.max("mention").alias("mention"), F.transform(F.array_sort(F.collect_list(F.struct("part", "surrogate"))), lambda x: x["surrogate"]).alias("parts"))
    news = parts.select("sha", "pos", fill("mention", "parts").alias("new")).groupBy("sha").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("news"))
    news = written(news, "news").select(F.col("sha").alias("__sha"), F.col("news").alias("__news"))
    short = mentions.where(F.aggregate("mentions", F.lit(0), lambda a, m: a + F.length(m)) <= _HOT_CHARS)  # what is broadcast is bounded in length, too
    repeated = _hot(short.select(F.col("sha").alias("__sha"), "n"))
    between = F.split(F.col(text), PATTERN, -1)
    whole = F.when(F.col("__news").isNull(), F.col(text)).otherwise(F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("b"), F.col("__news").alias("n")), lambda x: F.array(x["b"], F.coalesce(x["n"], F.lit(""))))), ""))
    some = _joined(docs.where(maybe).select(*columns, sha.alias("__sha")), news, ["__sha"], repeated, "left")
    changed = some.select(*(whole.alias(c) if c == text else F.col(c) for c in columns), F.coalesce(F.size("__news"), F.lit(0)).alias("pii_entities"))
    return docs.where(~maybe).select(*columns, F.lit(0).alias("pii_entities")).unionByName(changed)


def op7(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, pii_entities (mentions replaced)."""
    return replaced(docs.select("doc_id", "text"), key)
