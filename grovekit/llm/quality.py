"""Quality rules over a bitmask ledger.  DataFrame functions only.

1. *Ledger.*  ``ledger`` reads each text once, takes its measurements and
   evaluates every rule; rule i's failure is bit i of ``failures``.  The ledger
   has no text, so it is small, and policies need nothing else.
2. *Policies.*  A ``Policy`` names its version, the rules that it applies and how
   many failures it puts up with.  ``judge`` gives each row's verdict under any
   number of policies, by bit operations on the ledger.
3. *Ablations.*  ``ablations`` counts the ledger's distinct bitmasks (at most two
   to the power of the number of rules, summed map-side first), and reads off
   them what each rule of a policy removes, removes alone, and what the policy
   would keep without it.  ``profile`` folds the bitmasks of a group with
   ``bit_or`` and ``bit_and``: the rules that fail somewhere, and everywhere.

Words are the runs of ``[^\\x20\\x09-\\x0D]``.  Measurements: ``n_words``;
``word_chars``, code points in words; ``n_symbols``, characters of
``[#*$%&|<>]``; ``n_lines``, lines (split at \\n) with a word, and ``n_dup_lines``,
those equal to an earlier one; ``n_repeat_words``, words in three-word windows
that the text has twice or more, the first included; ``n_lettered``, words with a
letter; ``n_upper``, characters of ``[A-Z]``; ``n_bullets``, lines that begin with
one of ``-*•``; ``n_ellipses``, lines that end in ``...`` or ``…``.

Defined results: a null text counts as empty and fails ``short`` only, as the
other rules compare with the number of words or lines; repeated rows and null
ids have rows of their own; an empty table gives an empty ledger and ablations
of zeros; all columns but the text pass, and those named as the ledger's are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACES = " \t\n\x0b\f\r"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_lettered", "n_upper", "n_bullets", "n_ellipses"]


@dataclass(frozen=True)
class Rule:
    name: str
    failure: str  # SQL over the measurements


#: A rule's place is its bit in stored ledgers: append, never reorder.
RULES = [
    Rule("short", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("few_letters", "100 * n_lettered < 80 * n_words"),
    Rule("upper_case", "100 * n_upper > 30 * word_chars"),
    Rule("bullets", "100 * n_bullets > 90 * n_lines"),
    Rule("ellipses", "100 * n_ellipses > 30 * n_lines"),
]


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]
    tolerated: int = 0  # failures of its rules that a kept text may have

    def mask(self, rules: list[Rule]) -> int:
        places = {r.name: i for i, r in enumerate(rules)}
        if unknown := set(self.rules) - set(places):
            raise ValueError(f"policy {self.version} names unknown rules: {sorted(unknown)}")
        return sum(1 << places[name] for name in set(self.rules))


BASE = Policy("base-1", ("short", "repeated_windows"))
PROSE = Policy("prose-1", tuple(r.name for r in RULES))


def windows_hash(words: str, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _upper(key: Column) -> Column:
    return F.shiftright(key, 32)


def _place(key: Column) -> Column:
    return key.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _meeting(keys: Column) -> Column:
    """The sorted keys whose upper half is another's too."""
    return F.filter(keys, lambda x, k: (_upper(x) == _upper(F.get(keys, k - 1))) | (_upper(x) == _upper(F.get(keys, k + 1))))


def _repeated(met: Column, words: Column) -> Column:
    """Places of the windows that stand twice or more, among sorted keys that meet in their upper half."""
    word = lambda x, j: F.get(words, _place(x) + j)
    differ = lambda x, y: (word(x, 0) != word(y, 0)) | (word(x, 1) != word(y, 1)) | (word(x, 2) != word(y, 2))
    clash = F.filter(met, lambda x, k: (_upper(x) == _upper(F.get(met, k - 1))) & differ(x, F.get(met, k - 1)))
    # different windows with one hash: these few texts are sorted by the words themselves
    spelt = F.sort_array(F.transform(met, lambda x: F.struct(F.array(*[word(x, j) for j in range(3)]).alias("w"), _place(x).alias("i"))))
    same = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
    slow = F.transform(F.array(spelt), lambda s: F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["i"]))[0]
    return F.when(F.size(clash) == 0, F.transform(met, _place)).otherwise(slow)


def _covered(places: Column) -> Column:
    """Words that three-word windows at these places cover."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    grow = lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(i - s["last"], F.lit(3))).alias("n"))
    return F.aggregate(F.sort_array(places), start, grow, lambda s: s["n"])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``' columns but the text, with ``MEASURES`` (long)."""
    passed = [c for c in docs.columns if c != text and c not in [*MEASURES, "failures"]]
    names = {c: f"c{i}" for i, c in enumerate(passed)}
    t = F.col("t")
    read = docs.select(*[F.col(c).alias(a) for c, a in names.items()], F.coalesce(F.col(text), F.lit("")).alias("t"))
    bare = F.btrim(t, F.lit(_SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    cut = read.withColumns({"w": words, "l": lines})
    # half a hash above, the window's place below; windows that meet by their upper half are compared word by word
    key = lambda i: F.shiftleft(windows_hash("w", i), 32) + i
    keyed = cut.withColumn("keys", F.sort_array(F.when(F.size("w") > 2, F.transform(F.sequence(F.lit(0), F.size("w") - 3), key)).otherwise(F.array().cast("array<bigint>"))))
    found = keyed.withColumn("met", _meeting(F.col("keys")))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    measures = {
        "n_words": F.size("w"),
        "word_chars": F.length(F.array_join("w", "")),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_lines": F.size("l"),
        "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")),
        "n_repeat_words": _covered(_repeated(F.col("met"), F.col("w"))),
        "n_lettered": count(r"\p{L}[^\x20\x09-\x0D]*+"),
        "n_upper": count("[A-Z]"),
        "n_bullets": F.size(F.filter("l", lambda x: F.ltrim(x).rlike("^[-*•]"))),
        "n_ellipses": F.size(F.filter("l", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
    }
    taken = found.select(*names.values(), *[measures[m].cast("long").alias(m) for m in MEASURES])
    return taken.select(*[F.col(a).alias(c) for c, a in names.items()], *MEASURES)


def ledger(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``measured`` with ``failures``: bit i is set where rule i fails."""
    rules = RULES if rules is None else rules
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules at most")
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits + F.when(F.expr(rule.failure), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return measured(docs, text).withColumn("failures", bits)


def passes(policy: Policy, rules: list[Rule] | None = None) -> Column:
    """Whether a row of a ledger passes the policy."""
    failed = F.bit_count(F.col("failures").bitwiseAND(F.lit(policy.mask(RULES if rules is None else rules)).cast("long")))
    return failed <= policy.tolerated


def judge(found: DataFrame, policies: list[Policy], rules: list[Rule] | None = None) -> DataFrame:
    """The ledger with ``kept``: a map from each policy's version to its verdict."""
    pairs = [x for p in policies for x in (F.lit(p.version), passes(p, rules))]
    return found.withColumn("kept", F.create_map(*pairs))


def ablations(found: DataFrame, policy: Policy, rules: list[Rule] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """For each rule of the policy and group ``by``: rows, kept, failing (the rule), alone (removed, and kept without it), kept_without."""
    rules = RULES if rules is None else rules
    mask, places = policy.mask(rules), {r.name: i for i, r in enumerate(rules)}
    table = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << places[n]).cast("long").alias("bit")) for n in sorted(set(policy.rules), key=places.get)])
    groups = found.groupBy(*by, F.col("failures").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    each = groups.select(*by, "bits", "n", F.inline(table))
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    failed = F.bit_count("bits")
    keeps, keeps_without = failed <= policy.tolerated, failed - fails.cast("int") <= policy.tolerated
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    summed = each.groupBy(*by, "rule").agg(F.sum("n").alias("rows"), count(keeps)("kept"), count(fails)("failing"), count(keeps_without & ~keeps)("alone"), count(keeps_without)("kept_without"))
    if by:
        return summed
    every = found.sparkSession.range(1).select(F.inline(table)).select("rule")
    return every.join(summed, "rule", "left").select("rule", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "kept", "failing", "alone", "kept_without")])


def profile(found: DataFrame, *by: str) -> DataFrame:
    """For each group: rows, ``fails_somewhere`` and ``fails_everywhere`` as bitmasks."""
    return found.groupBy(*by).agg(F.count("*").alias("rows"), F.bit_or("failures").alias("fails_somewhere"), F.bit_and("failures").alias("fails_everywhere"))


#: The registered query in DuckDB: base measurements and the verdict of ``PROSE``.
SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
cut AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    row_number() OVER () AS rid
  FROM texts),
windows AS (SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM cut)),
again AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, x) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_lettered, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
    len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•]'))) AS n_bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS n_ellipses
  FROM cut LEFT JOIN repeated USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words
    OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_lettered < 80 * n_words OR 100 * n_upper > 30 * word_chars
    OR 100 * n_bullets > 90 * n_lines OR 100 * n_ellipses > 30 * n_lines) AS kept
FROM m
"""
