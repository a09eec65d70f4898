"""Quality rules as a bitmask ledger, in DataFrame functions only.

`ledger` evaluates every rule once per text and keeps the measurements and one failure bit per rule.  Policies name
the bits that reject and carry a version, so a verdict under any policy, and what each of its rules adds, come from
the ledger without reading the texts again.

Words are `[^\\x20\\x09-\\x0D]+`; null and blank texts have none.  A line counts as repeated if it has a word and equals
an earlier line.  A word is repeated if it lies in a 3-word window that is found twice or more in its text.  Rows stand
for themselves (repeated rows give repeated results, null identifiers stay); input columns are kept in `row`, so names
cannot clash; an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Rule name to the SQL condition, over measurements, under which a text fails it.  The order gives the bits.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 15 * n_words",
    "no_words": "n_words = 0",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: Policy versions: the rules that reject.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "web-2": ("few_words", "repeated_words", "symbols", "repeated_lines", "long_words"),
}


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _word(text: str) -> str:
    return f"translate({text}, ' \\t\\n\\u000b\\f\\r', '')"


def ledger(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row: struct of the carried columns, measurements long, failures long: a bit for each rule that fails)."""
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    carried = F.struct(*(docs[f"`{x}`"] for x in (docs.columns if carry is None else carry)))
    df = docs.select(carried.alias("row"), text.alias("text"))
    df = df.select(
        "row",
        F.array_remove(F.split(F.translate("text", SPACES, " " * 6), " "), "").alias("words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: F.translate(line, SPACES, "") != "").alias("lines"),
    )
    # a window's hash decides only that a text has no repeated window; texts with equal hashes compare the words
    df = df.select(
        "row", "word_chars", "n_symbols", "words",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(words) >= 3 THEN zip_with(zip_with(slice(words, 1, size(words) - 2), slice(words, 2, size(words) - 2), (a, b) -> xxhash64(a, b)), slice(words, 3, size(words) - 2), (h, d) -> xxhash64(h, d)) ELSE array() END").alias("hashes"),
    )
    df = df.withColumn("repeats", F.size("hashes") > F.size(F.array_distinct("hashes")))
    df = df.withColumn("placed", F.expr("CASE WHEN repeats THEN array_sort(transform(hashes, (h, i) -> struct(h, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c, i))) END"))
    pairs = "zip_with(slice(placed, 1, size(placed) - 1), slice(placed, 2, size(placed) - 1), (x, y) -> CASE WHEN x.h = y.h AND x.a = y.a AND x.b = y.b AND x.c = y.c THEN array(x.i, x.i + 1, x.i + 2, y.i, y.i + 1, y.i + 2) END)"
    df = df.withColumn("n_repeat_words", F.expr(f"CASE WHEN repeats THEN size(array_distinct(flatten(filter({pairs}, p -> p IS NOT NULL)))) ELSE 0 END").cast("long"))
    measured = df.select("row", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measured.withColumn("failures", failures)


def kept(policy: str) -> Column:
    """Whether a ledger row passes every rule of a policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def passing(ledger: DataFrame, policy: str) -> DataFrame:
    """Ledger rows that pass a policy.

    The row number keeps the filter above the projection that computes the bits: pushed below it, the filter would
    repeat the nested measurements once for each rule that mentions them, and planning would not end.
    """
    numbered = ledger.withColumn("place", F.monotonically_increasing_id())
    return numbered.where((F.col("place") >= 0) & kept(policy)).drop("place")


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """(policy, rule, failing, only_rule): for each rule of a policy, the rows that fail it and those that only it rejects.

    Rows are first counted by failure bits, so the rest handles 2 ** rules groups at most.
    """
    own = mask(policy)
    counted = ledger.groupBy(F.col("failures").bitwiseAND(F.lit(own).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy])))
    return (
        counted.select("bits", "n", rules.alias("r"))
        .groupBy(F.lit(policy).alias("policy"), F.col("r.rule").alias("rule"))
        .agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only_rule"))
    )
