"""Quality rules: a threshold table compiled into one projection.

Every rule is a ratio of two columns of the text's statistics with a lowest and a highest allowed
value. The statistics are built-in expressions on the row alone, so the plan has no shuffle and
no Python. Sorting and hash sets keep the work near-linear in the length of a text.

Null text counts as empty text: no words, hence ``base_failed``. Other columns pass through,
also those with names used here: statistics live in one struct until the last projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]+"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the and of to in a is that it for on was with as are be this by at from or an",
    "der die das und in den von zu mit ist im nicht ein eine als auch dem des sich es er sie auf für",
    "le la les de des et en un une est que qui dans pour pas du au avec sur ne se par ce il elle",
    "el los las y en un una que del se por con para no es su al lo como de",
)


@dataclass(frozen=True)
class Rule:
    """``above / below`` must lie in [low, high]; texts under ``least_words`` words are exempt."""

    name: str
    above: str
    below: str | None
    low: float | None = None
    high: float | None = None
    least_words: int = 0


#: The table of thresholds; any other list of rules over the statistics can be given.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 1.5, 14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.12),
    Rule("shouted_words", "n_shouted", "n_words", None, 0.35),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.35),
    Rule("bulleted_lines", "n_bullets", "n_lines", None, 0.9),
    Rule("stop_words", "n_stop", "n_words", 0.02, None, 60),
)


def _stages(text: Column) -> list[dict[str, Column]]:
    """Expressions in layers; each layer may use the names of those before it."""
    c = F.col
    stop = sorted({w for line in STOP_WORDS for w in line.split()})
    return [
        {"_t": F.coalesce(text, F.lit(""))},
        {"_w": F.regexp_extract_all("_t", F.lit(f"({WORD})"), F.lit(1)),
         "_lines": F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0),
         "n_symbols": F.regexp_count("_t", F.lit(f"[{SYMBOLS}]")).cast("long"),
         "n_shouted": F.regexp_count("_t", F.lit(r"(?<![\p{L}])\p{Lu}{2,}!")).cast("long")},
        {"n_words": F.size("_w").cast("long"),
         "word_chars": F.length(F.array_join("_w", "")).cast("long"),
         "n_lines": F.size("_lines").cast("long"),
         "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
         "n_bullets": F.size(F.filter("_lines", lambda x: F.ltrim(x).rlike(r"^[-*•]"))).cast("long"),
         "n_stop": F.size(F.filter("_w", lambda w: F.lower(w).isin(stop))).cast("long"),
         "_h": F.transform("_w", lambda w: F.xxhash64(w))},
        {"_grams": F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - 4, F.lit(0))), lambda h, i: F.xxhash64(
            h, *[F.get(c("_h"), i + k) for k in range(1, 5)]))},
        # Only a text with a repeated window pays for the sort that finds where it repeats.
        {"_sorted": F.when(F.size("_grams") > F.size(F.array_distinct("_grams")), F.array_sort(
            F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))},
        {"_again": F.array_sort(F.transform(F.filter(
            F.transform("_sorted", lambda x, k: F.struct(
                x["i"].alias("i"),
                ((F.get(c("_sorted"), k - 1)["h"] == x["h"]) | (F.get(c("_sorted"), k + 1)["h"] == x["h"])).alias("twice"))),
            lambda x: F.coalesce(x["twice"], F.lit(False))), lambda x: x["i"]))},
        {"n_repeat_words": F.coalesce(F.aggregate(
            F.transform("_again", lambda i, k: F.least(F.coalesce(F.get(c("_again"), k + 1) - i, F.lit(5)), F.lit(5))),
            F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")},
    ]


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bullets", "n_stop", "n_shouted")


def compile_rules(rules: tuple[Rule, ...], value) -> Column:
    """The names of the rules that a text breaks, as one expression. ``value(name)`` is a statistic."""
    broken = []
    for rule in rules:
        ratio = value(rule.above).cast("double")
        if rule.below:
            ratio = ratio / F.nullif(value(rule.below), F.lit(0).cast("long"))
        out = F.lit(False)
        if rule.low is not None:
            out = out | (ratio < rule.low)
        if rule.high is not None:
            out = out | (ratio > rule.high)
        out = out & (value("n_words") >= rule.least_words)
        broken.append(F.when(F.coalesce(out, F.lit(False)), F.lit(rule.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def with_quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES,
                 least_words: int = 10, most_repeated: int = 20, name: str = "quality") -> DataFrame:
    """Add the struct ``name``: the statistics, ``base_failed``, ``broken`` (rule names) and ``kept``."""
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    for layer in _stages(F.col("_row").getField(text)):
        row = row.select("*", *[e.alias(n) for n, e in layer.items()])
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    judged = row.select("_row", *STATISTICS, base.alias("base_failed"), compile_rules(rules, F.col).alias("broken"))
    kept = ~F.col("base_failed") & (F.size("broken") == 0)
    out = F.struct(*STATISTICS, "base_failed", "broken", kept.alias("kept"))
    rest = [F.col("_row").getField(c).alias(c) for c in df.columns if c != name]
    return judged.select(*rest, out.alias(name))


def keep_good(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows that no rule rejects, with their own columns.

    A filter would be pushed below the layers of the projection and copy each into its condition;
    a generator of one row or none leaves them as they are.
    """
    judged = with_quality(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_own"), F.col(f"`{text}`").alias("_text")), "_text", **options)
    return judged.select(F.inline(F.when(F.col(f"{options.get('name', 'quality')}.kept"), F.array("_own"))))
