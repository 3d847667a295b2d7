"""Text and answer readers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Answer phrases and their codes.
LIKERT_PHRASES = {
    "strongly disagree": 1,
    "strongly agreed": 5,
    "strongly agree": 5,
    "neither agree nor disagree": 3,
    "neither agree or disagree": 3,
    "neutral": 3,
    "disagree": 2,
    "agree": 4,
}
#: Words that mean yes or no.
YES = ["yes", "yeah", "yep", "yup", "true", "correct"]
NO = ["no", "nope", "nah", "false", "incorrect"]
#: Marks stripped off both ends of a reply.
OUTER_MARKS = r"[\s.,;:!?'\"`*\-_()\[\]]+"
#: Words that soften a claim, and words that make it absolute.
HEDGES = ["sometimes", "usually", "often", "generally", "tend", "tends", "maybe", "might", "somewhat", "rather", "fairly", "occasionally", "mostly", "typically", "quite", "prefer"]
ABSOLUTES = ["always", "never", "every", "all", "none", "completely", "entirely", "exactly", "only", "nothing", "everyone", "anyone"]


def stripped(text: Column) -> Column:
    """Without white space at either end; SQL trim() would only take blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_text(text: Column) -> Column:
    """Lower case, only a-z, 0-9 and single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def clean(text: Column) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z']+"), F.lit(0)))


def wording_features(text: Column, kind: Column | None = None) -> Column:
    """Words, whether hedges and absolute words occur, and, where the item's type is given, whether it is binary."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z']+"), F.lit(0))
    has = lambda ws: F.arrays_overlap(words, F.array(*map(F.lit, ws))).cast("int")
    more = [] if kind is None else [F.coalesce(kind == "binary", F.lit(False)).cast("int").alias("is_binary")]
    return F.struct(F.size(words).alias("n_words"), has(HEDGES).alias("hedge"), has(ABSOLUTES).alias("absolute"), *more)


def _words(options: list[str]) -> str:
    """A pattern of whole words or phrases, the longest first where one begins like another."""
    return "(?<![a-z])(" + "|".join(sorted(options, key=len, reverse=True)) + ")(?![a-z])"


def likert_candidates(text: Column) -> Column:
    """Distinct answers that a text may mean: the codes of its phrases, and lone digits 1-5 outside these."""
    cleaned, pattern = clean(text), _words(list(LIKERT_PHRASES))
    codes = F.create_map(*[F.lit(x) for pair in LIKERT_PHRASES.items() for x in pair])
    phrases = F.transform(F.regexp_extract_all(cleaned, F.lit(pattern), F.lit(1)), lambda p: F.element_at(codes, p))
    digits = F.regexp_extract_all(F.regexp_replace(cleaned, pattern, " "), F.lit(r"(?<![0-9.])[1-5](?![0-9]|\.[0-9])"), F.lit(0)).cast("array<int>")
    return F.array_sort(F.array_distinct(F.concat(phrases, digits)))


def binary_candidates(text: Column) -> Column:
    """`yes` and `no`, as far as a text may mean them; a lone y or n, outer marks apart, decides by itself."""
    cleaned = clean(text)
    bare = F.regexp_replace(cleaned, f"^{OUTER_MARKS}|{OUTER_MARKS}$", "")
    found = F.array_compact(F.array(F.when(cleaned.rlike(_words(YES)), F.lit("yes")), F.when(cleaned.rlike(_words(NO)), F.lit("no"))))
    return F.when(bare == "y", F.array(F.lit("yes"))).when(bare == "n", F.array(F.lit("no"))).otherwise(found)


def normalize_answer(text: Column, kind: Column) -> Column:
    """struct(answer, reason): the only candidate, or why there is none."""
    options = F.when(kind == "likert5", likert_candidates(text).cast("array<string>")).when(kind == "binary", binary_candidates(text))
    n = F.size(options)
    reason = (
        F.when(F.coalesce(stripped(text), F.lit("")) == "", "empty")
        .when(options.isNull(), "unknown type")
        .when(n == 0, "none")
        .when(n > 1, "ambiguous")
    )
    return F.struct(F.when(reason.isNull(), F.element_at(options, 1)).alias("answer"), reason.alias("reason"))


def parse_score(text: Column, low: int, high: int) -> Column:
    """A whole number reply, else the last whole number in range; null if there is none."""
    numbers = F.regexp_extract_all(text, F.lit(r"(?<![0-9.])-?[0-9]{1,9}(?![0-9]|\.[0-9])"), F.lit(0)).cast("array<int>")
    inside = F.filter(numbers, lambda v: (v >= low) & (v <= high))
    return F.when(F.size(inside) > 0, F.element_at(inside, -1))


def is_clean_reply(text: Column, low: int, high: int) -> Column:
    value = stripped(text)
    return F.coalesce(F.when(value.rlike(r"^[+-]?[0-9]{1,9}$"), value.cast("int").between(low, high)), F.lit(False))


def parse_shares(text: Column) -> Column:
    """`A=0.2 B=0.8` to a map that sums to 1; the last value of a key wins; null where nothing sums up."""
    pairs = F.regexp_extract_all(text, F.lit(r"[A-C]\s*=\s*[0-9.]+"), F.lit(0))
    entry = F.transform(pairs, lambda p: F.struct(F.substring(p, 1, 1).alias("key"), F.regexp_extract(p, r"=\s*([0-9]*\.?[0-9]+)", 1).try_cast("double").alias("value")))
    keys = F.array_distinct(F.transform(entry, lambda e: e["key"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(entry, lambda e: e["key"] == k), -1))
    total = F.aggregate(last, F.lit(0.0), lambda a, e: a + e["value"])
    return F.when(total > 0, F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"].alias("key"), (e["value"] / total).alias("value")))))


def leak_reasons(text: Column, names: list[str]) -> Column:
    """Reasons why a text gives a hidden trait away: a named trait, or a signed number."""
    low = F.lower(text)
    named = [F.when(low.rlike(rf"(?<![a-z]){n}(?![a-z])"), F.lit(f"name:{n}")) for n in names]
    number = F.when(text.rlike(r"(?<![0-9A-Za-z])[+-][0-9]"), F.lit("number"))
    return F.array_compact(F.array(*named, number))


def clock(minutes: Column) -> Column:
    """Minutes of the day as HH:MM; the minutes are rounded half to even, so :60 can occur."""
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), F.bround(minutes % 60).cast("int"))


def strength_bucket(value: Column) -> Column:
    size = F.abs(value)
    return F.when(size >= 1.2, "strong").when(size >= 0.5, "clear").when(size >= 0.15, "lean").otherwise("neutral")


def session_id(pid: Column, round_name: Column, seed: int) -> Column:
    key = F.concat_ws("|", round_name, F.lit(str(seed)), pid.cast("string"))
    return F.concat(round_name, F.lit("-"), F.substring(F.sha2(key, 256), 1, 10))


def first_json_object(text: Column) -> Column:
    """The first JSON object inside a text, as text; null if there is none.

    Braces are tried from the left. Each is closed where the count of braces outside strings comes back to zero (strings by double quotes,
    a backslash hides the next character), and counts if what it spans is JSON. Later braces are looked at only where earlier ones fail.
    """
    chars = F.split(text, "")
    opening = F.filter(F.transform(chars, lambda c, i: F.when(c == "{", i)), lambda i: i.isNotNull())

    def closed_at(start: Column) -> Column:
        state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("hidden"), F.lit(0).alias("read"), F.lit(0).alias("end"))

        def step(s: Column, c: Column) -> Column:
            quote = (c == '"') & ~s["hidden"]
            depth = s["depth"] + F.when(s["quoted"] | (s["end"] > 0), 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
            read = s["read"] + 1
            return F.struct(
                depth.alias("depth"),
                F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
                (s["quoted"] & ~s["hidden"] & (c == "\\")).alias("hidden"),
                read.alias("read"),
                F.when((s["end"] == 0) & (depth == 0), read).otherwise(s["end"]).alias("end"),
            )

        return F.aggregate(F.slice(chars, start + 1, F.size(chars)), state, step)["end"]

    def tried(found: Column, start: Column) -> Column:
        end = closed_at(start)
        span = F.when(end > 0, F.array_join(F.slice(chars, start + 1, end), ""))
        return F.when(found.isNotNull(), found).otherwise(F.when(F.try_parse_json(span).isNotNull(), span))

    return F.aggregate(opening, F.lit(None).cast("string"), tried)


#: Sums that shares may come to, and how near to them they must be.
SHARE_SUMS, SHARE_TOLERANCE = (100.0, 1.0), 0.25


def parse_distribution(text: Column, names: list[str]) -> Column:
    """Map of `name: number` or `name = number` pairs to shares that sum to one; names are single words, compared in lower case.

    Null unless each of `names`, and no other, stands there once, and the numbers sum to about one of SHARE_SUMS.
    """
    pairs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+\s*[:=]\s*(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"), F.lit(0))
    keys = F.transform(pairs, lambda p: F.lower(F.regexp_extract(p, r"^[A-Za-z0-9]+", 0)))
    values = F.transform(pairs, lambda p: F.regexp_extract(p, r"[0-9.]+$", 0).cast("double"))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    near = F.lit(False)
    for s in SHARE_SUMS:
        near = near | (F.abs(total / s - 1) <= SHARE_TOLERANCE)
    fits = (F.array_sort(keys) == F.array(*[F.lit(n) for n in sorted(n.lower() for n in names)])) & (total > 0) & near
    return F.when(fits, F.map_from_arrays(keys, F.transform(values, lambda v: v / total)))
