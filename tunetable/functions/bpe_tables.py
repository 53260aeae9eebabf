"""BPE as a relation (F2, S4): words meet the merges that can apply to them in joins.

A merge makes one token of two neighbouring ones. Where every merge of a file
makes a token of its own and its parts are made by earlier merges (checked),
merging "lowest rank first, leftmost first" is the same as going through the
merges once in rank order and rewriting every pair from left to right: a merge
can't open the way for one of a lower rank. And a merge can only apply to a
word that holds its token as a part. So

1. each distinct word is cut into its parts of at most the longest token;
2. one join with the merges, on the token they make, leaves each word the few
   merges that can apply, sorted by rank;
3. one fold rewrites the word through them.

All of it is DataFrame work. A word is encoded once, however often it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import materialize
from .bpe import BpeModel

#: Around each symbol while a word is rewritten: two noncharacters (fixed values).
_OPEN, _CLOSE = "﷐", "﷑"


def check_merges(merges: DataFrame) -> int:
    """The longest token that a merge makes, in symbols of one character; raises if the merges can't be taken in rank order."""
    made = merges.select("rank", "left", "right", F.concat("left", "right").alias("made"))
    earlier = made.select(F.col("made").alias("part"), F.col("rank").alias("at"))
    late = made.select("rank", F.explode(F.array("left", "right")).alias("part")).join(earlier, "part").filter("at >= rank")
    n = made.agg(F.count("*").alias("n"), F.count_distinct("made").alias("k"), F.max(F.length("made")).alias("m")).first()
    if n["n"] != n["k"] or not late.isEmpty():
        raise ValueError("merges that make one token twice, or use parts made later, can't be taken in rank order")
    return n["m"] or 1


def symbols(word: Column, model: BpeModel) -> Column:
    """The word as a string of one character a symbol: its characters, or the stand-ins of its UTF-8 bytes."""
    if not model.byte_level:
        return word
    odd = {b: c for b, c in enumerate(model.byte_symbols) if c != chr(b)}
    return F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "".join(map(chr, odd)), "".join(odd.values()))


def pieces(text: Column, model: BpeModel) -> Column:
    """The pieces of a text without special tokens, in order."""
    return F.regexp_extract_all(text, F.lit("(?U)" + model.pattern), F.lit(0))


def encode_words(words: DataFrame, model: BpeModel, vocab: DataFrame, merges: DataFrame, word_col: str = "word") -> DataFrame:
    """``(word, ids array<int>)`` of each distinct piece in ``words``; unknown characters become the unknown id, one each, or nothing if there is none."""
    longest = check_merges(merges)
    suffix, n = F.lit(model.suffix), F.length("s")
    plain = F.translate(symbols(F.col("word"), model), _OPEN + _CLOSE, "﷒" * 2)  # none is in a vocabulary
    w = words.select(F.col(word_col).alias("word")).filter("word <> ''").distinct().withColumn("s", plain)
    at = w.filter(n > 1).select("word", "s", F.explode(F.sequence(F.lit(1), n - 1)).alias("i"))
    at = at.select("word", "s", "i", F.explode(F.sequence(F.lit(2), F.least(F.lit(max(longest, 2)), n - F.col("i") + 1))).alias("k"))
    part = F.substr("s", F.col("i"), F.col("k"))
    parts = at.select("word", F.when(F.col("i") + F.col("k") - 1 == n, F.concat(part, suffix)).otherwise(part).alias("made"))
    made = merges.select(F.concat("left", "right").alias("made"), "rank", "left", "right")
    # most parts are no tokens and end at the join; what is left is bounded by the word's parts
    own = parts.join(made, "made").groupBy("word").agg(F.sort_array(F.collect_set(F.struct("rank", "left", "right"))).alias("m"))
    wrapped = F.regexp_replace(F.substr("s", F.lit(1), n - 1), "(?s)(.)", f"{_OPEN}$1{_CLOSE}")
    start = F.concat(wrapped, F.lit(_OPEN), F.substr("s", n, F.lit(1)), suffix, F.lit(_CLOSE))
    pair = lambda m: F.concat(F.lit(_OPEN), m["left"], F.lit(_CLOSE + _OPEN), m["right"], F.lit(_CLOSE))
    whole = lambda m: F.concat(F.lit(_OPEN), m["left"], m["right"], F.lit(_CLOSE))
    none = F.array().cast("array<struct<rank:int,left:string,right:string>>")
    done = w.join(own, "word", "left").select("word", F.aggregate(F.coalesce("m", none), start, lambda s, m: F.replace(s, pair(m), whole(m))).alias("s"))
    tokens = done.select("word", F.posexplode(F.split(F.substr("s", F.lit(2), F.length("s") - 2), _CLOSE + _OPEN)).alias("pos", "token"))
    ids = tokens.join(vocab, "token", "left").select("word", "pos", F.coalesce("id", F.lit(model.unk_id).cast("int")).alias("id"))
    known = F.when(F.col("id").isNotNull(), F.struct("pos", "id"))
    return ids.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(known)), lambda s: s["id"]).alias("ids"))  # bounded by the word


def token_usage(df: DataFrame, text_col: str, model: BpeModel, vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """``(id, n)``: how often each token occurs in a column of texts without special tokens or [SPACE].

    Pieces are counted first, so a frequent word is one row after the partial
    count, and each distinct one is encoded once. The counts are stored: the
    corpus is read once.
    """
    counted = materialize(df.select(F.explode(pieces(F.col(text_col), model)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    encoded = encode_words(counted, model, vocab, merges)
    return counted.join(encoded, "word").select("n", F.explode("ids").alias("id")).groupBy("id").agg(F.sum("n").alias("n"))
