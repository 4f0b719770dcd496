"""Column expressions over text and token arrays. JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The word marker of sentence models, the unknown tokens, and the continuation prefix (fixed values).
MARKER, UNK, WP_UNK, CONTINUES = "▁", "<unk>", "[UNK]", "##"
#: Segmentations are held as one string, each token between these two; neither may occur in text.
OPEN, CLOSE = "\x01", "\x02"
#: What Unicode counts as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(line: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(_col(line), F.lit(WHITE))


def characters(text: Column | str) -> Column:
    """One element per code point; none for an empty text."""
    t = _col(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ""))


def continuation_pieces(word: Column | str) -> Column:
    """First character bare, each later one with the continuation prefix."""
    return F.transform(characters(word), lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit(CONTINUES), c)))


def marked_sentence(sentence: Column | str) -> Column:
    """Runs of spaces and tabs part words; each word gets the marker in front. Blank gives ''."""
    s = F.btrim(_col(sentence), F.lit(" \t"))
    return F.when(s == "", "").otherwise(F.concat(F.lit(MARKER), F.regexp_replace(s, "[ \t]+", MARKER)))


def held(tokens: Column) -> Column:
    """A token array as one string; an error if a token holds what parts them."""
    text = F.array_join(tokens, "")
    bad = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))
    return F.when(bad, F.raise_error(F.lit("texts to be segmented must not hold U+0001 or U+0002"))).otherwise(F.array_join(F.transform(tokens, lambda t: F.concat(F.lit(OPEN), t, F.lit(CLOSE))), ""))


def tokens_of(state: Column | str) -> Column:
    """The array of a held segmentation."""
    s = _col(state)
    return F.when(F.length(s) < 2, F.array().cast("array<string>")).otherwise(F.split(F.substring(s, F.lit(2), F.length(s) - 2), CLOSE + OPEN))


def applied_rules(state: Column, rules: list[tuple[str, str, str]], step: int = 64) -> Column:
    """All (left, right, merged) in order. Rules sit in literal arrays of bounded size."""
    for lo in range(0, len(rules), step):
        items = [F.struct(F.lit(OPEN + a + CLOSE + OPEN + b + CLOSE).alias("p"), F.lit(OPEN + m + CLOSE).alias("m")) for a, b, m in rules[lo : lo + step]]
        state = F.aggregate(F.array(*items), state, lambda s, r: F.replace(s, r["p"], r["m"]))
    return state


def joined_pair(left: Column, right: Column) -> Column:
    """Concatenation where the right piece gives up one continuation prefix."""
    return F.concat(left, F.when(F.startswith(right, F.lit(CONTINUES)), F.substring(right, 3, 1_000_000)).otherwise(right))


def pair_score(pair: Column, left: Column, right: Column) -> Column:
    """c_ab / (c_a c_b), 0 where a side was never seen."""
    safe = (left == 0) | (right == 0)
    return F.when(safe, F.lit(0.0)).otherwise(pair.cast("double") / (left.cast("double") * right.cast("double")))


def packed_pair(left: Column, right: Column) -> Column:
    """Two ids in one number."""
    return F.shiftleft(left.cast("long"), 32).bitwiseOR(right.cast("long"))


def unpacked_pair(pair: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(pair, 32).cast("int"), pair.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def adjacent(tokens: Column) -> Column:
    """(l, r) at every place, overlapping ones too."""
    n = F.size(tokens)
    left, right = F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(left, right, lambda a, b: F.struct(a.alias("l"), b.alias("r")))


def is_protected(token: Column | str) -> Column:
    """Single characters, and whatever starts with '<', are never pruned."""
    return (F.length(_col(token)) == 1) | F.startswith(_col(token), F.lit("<"))


def covered(tokens: Column, alphabet: list[str]) -> Column:
    """Characters outside the alphabet become <unk>. The alphabet is a literal; its size is checked."""
    known = F.lit("".join(alphabet))  # single characters, so a substring test is a membership test
    return F.transform(tokens, lambda c: F.when(F.contains(known, c), c).otherwise(F.lit(UNK)))
