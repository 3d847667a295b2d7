"""Operator 7, quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (0) or abstains (-1) on a document. Expectation-maximisation over
the counts of vote patterns estimates how often each rule casts each vote on good and on bad
documents; a document's posterior quality then decides, instead of all rules having to pass.
`base_failed` tells which documents fail the base rules; only the query op7 keeps none of these.

The pattern table has at most 3 ** len(RULES) rows whatever the input, so the iterations, one SQL expression over these,
cost the same at any size. Documents are read once: their slim statistics are written to the shared
folder and read again for the verdict.

Defined results: null and empty texts, and others without words, fail the base rules and are not kept; ties
cannot occur as every document is judged alone; repeated rows get equal results; an empty table
gives an empty result; very long texts are judged whole. `keep` columns named like an output, in any case, are replaced by the output, all others are
returned as they came.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written

WORD = r"[^\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_letters", "n_shouts", "n_symbol_runs"]


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, else good where `good` holds, else abstains."""

    name: str
    bad: str
    good: str


#: Over the statistics of `with_stats`.
RULES = [
    Rule("length", "n_words < 20", "n_words >= 80"),
    Rule("word_length", "word_chars < 2.2 * n_words OR word_chars > 14 * n_words", "word_chars BETWEEN 3 * n_words AND 11 * n_words"),
    Rule("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    Rule("symbol_runs", "n_symbol_runs > 0.05 * n_words", "n_symbol_runs <= 0.01 * n_words"),
    Rule("letters", "n_letters < 0.86 * word_chars", "n_letters >= 0.9 * word_chars"),
    Rule("lines", "n_dup_lines >= 3 AND n_dup_lines > 0.3 * n_lines", "n_dup_lines <= 0.1 * n_lines"),
    Rule("repeats", "n_repeat_words > 0.35 * n_words", "n_repeat_words <= 0.1 * n_words"),
    Rule("capitals", "n_upper > 0.4 * n_letters", "n_upper <= 0.15 * n_letters"),
    Rule("shouts", "n_shouts > 0.1 * n_words", "n_shouts <= 0.01 * n_words"),
]

#: Where EM starts, and what its estimates are drawn to: P(vote | class) of any rule.
START_GOOD, START_BAD, START_PRIOR = (0.003, 0.97), (0.35, 0.62), 0.8
#: Weight of the start, as a share of all documents.
ANCHOR = 0.1
MAX_ROUNDS, TOLERANCE = 40, 1e-5
#: Up to so many words, 47 bits of a window's hash are compared before its words are.
LONG_WORDS = 1 << 16


def _repeated(keys: str, key_hash: str, key_place: str) -> tuple[str, str]:
    """SQL of the sorted window keys, and of the places of windows that are found twice, over the words `__words`."""
    built = f"if(n_words < 3, cast(array() as {'array<struct<h:bigint,i:bigint>>' if 'struct' in keys else 'array<bigint>'}), sort_array(transform(sequence(0L, n_words - 3L), i -> {keys})))"
    of = lambda k: (key_hash.format(k=k), key_place.format(k=k))

    def same(other: str) -> str:
        (h, i), (g, j) = of("k"), of(f"get(__keys, j {other})")
        words = " AND ".join(f"get(__words, int({i} + {d})) = get(__words, int({j} + {d}))" for d in range(3))
        return f"coalesce({g} = {h} AND {words}, false)"

    return built, f"sort_array(transform(filter(__keys, (k, j) -> {same('- 1')} OR {same('+ 1')}), k -> {of('k')[1]}))"


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the columns BASE and MORE, all long; columns of these names, in any case, are replaced.

    Windows are compared by sorting. Up to LONG_WORDS words a window is one long: the high bits of its
    hash and, below, its place in the text; in longer texts it is a pair of the whole hash and the place. Neighbours of equal hashes are
    then compared word by word.
    """
    window = "xxhash64(get(__words, int(i)), get(__words, int(i + 1)), get(__words, int(i + 2)))"
    bits = "length(bin(n_words))"
    mask = f"(shiftleft(1L, {bits}) - 1L)"
    short = _repeated(f"({window} & ~{mask}) | i", f"shiftright({{k}}, {bits})", f"({{k}} & {mask})")
    long = _repeated(f"struct({window} as h, i)", "{k}.h", "{k}.i")
    taken = {c.lower() for c in (*BASE, *MORE)}
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    step = step.withColumn("__words", F.expr(f"regexp_extract_all(__text, '{WORD}', 0)"))
    step = step.withColumn("n_words", F.size("__words").cast("long"))
    # one array of places, from keys of either kind
    places = [f"element_at(transform(array({keys}), __keys -> {found}), 1)" for keys, found in (short, long)]
    step = step.withColumn("__places", F.expr(f"if(n_words <= {LONG_WORDS}, {places[0]}, {places[1]})"))
    covered = "aggregate(transform(__places, (p, j) -> least(3L, coalesce(get(__places, j + 1) - p, 3L))), 0L, (a, x) -> a + x)"
    step = step.withColumn("__lines", F.expr(r"filter(split(__text, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    blank = F.regexp_replace("__text", r"[\x20\x09-\x0D]+", "")
    return step.select(
        *[F.col(f"__doc.`{c}`") for c in docs.columns if c.lower() not in taken],
        "n_words",
        F.length(blank).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.expr("cast(size(__lines) - size(array_distinct(__lines)) as bigint)").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("__text", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count("__text", F.lit("!!")).cast("long").alias("n_shouts"),
        F.regexp_count("__text", F.lit(SYMBOLS + "+")).cast("long").alias("n_symbol_runs"),
    )


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def vote(rule: Rule) -> Column:
    return F.expr(f"CASE WHEN {rule.bad} THEN 0 WHEN {rule.good} THEN 1 ELSE -1 END").cast("int")


@dataclass
class VoteModel:
    """prior: share of good documents; table[rule] = ((P(0|bad), P(1|bad)), (P(0|good), P(1|good)))."""

    prior: float
    table: list[tuple[tuple[float, float], tuple[float, float]]]

    def posterior(self, votes: list[Column]) -> Column:
        """P(good | votes); an abstention counts with its own probability.

        The logarithms are one array and the votes its places, so that the compiled plan is the same for all models.
        """
        ratios = [math.log(g / b) for bad, good in self.table for b, g in zip((1 - sum(bad), *bad), (1 - sum(good), *good), strict=True)]
        prior = math.log(self.prior / (1 - self.prior))
        numbers = F.array(*[F.lit(r + (prior if i < 3 else 0.0)) for i, r in enumerate(ratios)])
        odds = [F.get(numbers, v + F.lit(3 * i + 1)) for i, v in enumerate(votes)]
        return 1 / (1 + F.exp(-sum(odds[1:], odds[0])))


def start_model(n_rules: int) -> VoteModel:
    return VoteModel(START_PRIOR, [(START_BAD, START_GOOD)] * n_rules)


def _let(name: str, value: str, body: str) -> str:
    """SQL of `body` where `name` stands for `value`."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _sum(array: str) -> str:
    return f"aggregate({array}, 0D, (total, each) -> total + each)"


def fit_votes(patterns: DataFrame, names: list[str], rounds: int = MAX_ROUNDS) -> VoteModel:
    """EM over a table of vote patterns: columns `names` (0, 1 or -1) and `n`, the number of documents.

    All rounds are one SQL expression over one row that holds the patterns, 3 ** len(names) of them at most. Its state is an array: the
    prior, then for each rule P(0|bad), P(1|bad), P(0|good), P(1|good). It stays as it is once a round moves it by less than TOLERANCE. Estimates stay
    anchored to the start with the weight ANCHOR, so the two classes cannot change places.
    """
    m = len(names)
    votes = patterns.select(F.array(*[F.col(c).cast("int") for c in names]).alias("v"), F.col("n").cast("double").alias("n"))
    row = votes.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("p"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("total")).withColumn("w", F.lit(ANCHOR) * F.col("total"))

    # for each rule and vote, how many documents have it
    row = row.withColumn("cast_votes", F.expr(f"transform(sequence(0, {2 * m - 1}), k -> {_sum('transform(p, x -> if(x.v[k div 2] = k % 2, x.n, 0D))')})"))
    side = lambda at: f"(CASE k % 3 WHEN 0 THEN 1 - s[4 * (k div 3) + {at}] - s[4 * (k div 3) + {at + 1}] WHEN 1 THEN s[4 * (k div 3) + {at}] ELSE s[4 * (k div 3) + {at + 1}] END)"
    ratios = f"transform(sequence(0, {3 * m - 1}), k -> ln({side(3)} / {side(1)}))"
    odds = f"aggregate(sequence(0, {m - 1}), ln(s[0] / (1 - s[0])), (total, i) -> total + ratios[3 * i + x.v[i] + 1])"
    good = f"transform(p, x -> x.n / (1 + exp(-{odds})))"
    good_votes = f"transform(sequence(0, {2 * m - 1}), k -> {_sum('zip_with(p, good, (x, g) -> if(x.v[k div 2] = k % 2, g, 0D))')})"
    share = lambda seen, mass, start: f"({seen} + w * {start}D) / ({mass} + w)"
    shares = [share(f"cast_votes[2 * i + {v}] - good_votes[2 * i + {v}]", "total - good_mass", START_BAD[v]) for v in (0, 1)]
    shares += [share(f"good_votes[2 * i + {v}]", "good_mass", START_GOOD[v]) for v in (0, 1)]
    new = f"concat(array({share('good_mass', 'total', START_PRIOR)}), flatten(transform(sequence(0, {m - 1}), i -> array({', '.join(shares)}))))"
    after = _let("new", new, f"struct(new AS s, array_max(zip_with(new, s, (a, b) -> abs(a - b))) < {TOLERANCE}D AS done)")
    after = _let("ratios", ratios, _let("good", good, _let("good_mass", _sum("good"), _let("good_votes", good_votes, after))))
    start = ", ".join(f"{x}D" for x in (START_PRIOR, *([*START_BAD, *START_GOOD] * m)))
    fitted = f"aggregate(sequence(1, {rounds}), struct(array({start}) AS s, false AS done), (state, round) -> if(state.done, state, {_let('s', 'state.s', after)}))"
    found = row.where("total > 0").select(F.expr(fitted).alias("state")).first()
    if found is None or rounds < 1:
        return start_model(m)
    prior, *rest = found["state"]["s"]
    return VoteModel(prior, [((rest[4 * i], rest[4 * i + 1]), (rest[4 * i + 2], rest[4 * i + 3])) for i in range(m)])


def judge_documents(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """The `keep` columns (all, if None), BASE, one vote_<rule> each, posterior, base_failed and kept: whether there are words and the posterior reaches `threshold`."""
    rules = rules or RULES
    names = [f"vote_{r.name}" for r in rules]
    columns = docs.columns if keep is None else keep
    outputs = {c.lower() for c in (*BASE, *names, "posterior", "base_failed", "kept")}
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns], F.lit(0).alias("__none")).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    scored = with_stats(carried)
    slim = written(scored.select("doc", *BASE, *[vote(r).alias(n) for r, n in zip(rules, names, strict=True)]), "quality-votes")
    patterns = written(slim.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "quality-patterns")
    model = fit_votes(patterns, names)
    judged = slim.withColumn("posterior", model.posterior([F.col(n) for n in names])).withColumn("base_failed", base_failed())
    judged = judged.withColumn("kept", (F.col("n_words") > 0) & (F.col("posterior") >= threshold))
    return judged.select(*[F.col(f"doc.`{c}`") for c in columns if c.lower() not in outputs], *judged.columns[1:])
