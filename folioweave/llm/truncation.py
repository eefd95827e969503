"""Texts cut off by field limits: final word trigrams against the same trigrams inside texts, in Spark SQL.

Every text is reduced to words with sentence ends kept as a mark; notes behind the text (rights, key words, class
numbers, links) and what a cut leaves visible (an ellipsis, a remark, half a tag, entity or character) are taken off
first; words in brackets are counted apart from those around.  Over all texts each trigram is counted inside a sentence and before a sentence end.  A text that ends without a
sentence end is cut if its last trigram is frequent inside sentences but almost never terminal.  Where a trigram is too
rare to say, shorter contexts are asked in turn, each with counts of its own:

  pair        the last two words;
  stem        the last word as the beginning of longer words, against its own uses: a word cut short;
  place       how often a sentence ends one word behind the two words before the last;
  word        the last word;
  behind      how often a sentence ends one word behind the word before the last;
  rate        how often any word ends a sentence.

What the counts can't say is reported apart: ``mark`` for a visible cut at a place where sentences may end, and
``length`` for texts of one source that pile up at one exact length without a final full stop.

Cases: NULL, empty and blank texts and texts that stand for a missing one are not judged; a text of fewer than
``least_words`` words counts nowhere and is judged by visible cuts alone; texts may have any length; repeated texts are
judged alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from folioweave.llm.canon import is_filler
from folioweave.operators.joins import skew_safe_left_join
from folioweave.session import materialise

# Words by which providers remark that they cut a text.
_REMARK = "cut|truncated|shortened|abridged|continued|continues|read more|see more|more"
# Notes that stand behind a text, by the words they begin with.
_NOTES = {"©": "©[^.]{0,80}", "(c) ": r"\(c\) [^.]{0,80}", "keywords:": "keywords:[^.]{0,300}", "msc:": "msc:[^.]{0,120}", "pacs ": "pacs [0-9. ,a-z+-]{1,60}", "code: ": r"code: \S+", "registered as ": r"registered as \S+", "deposit id: ": r"deposit id: \d+"}
_NOTE = rf"(?i)(?:(?:{'|'.join(_NOTES.values())})\.?\s*)+$"
# What a cut may leave behind the last word: a remark, an ellipsis, half a character, tag or entity, punctuation.
_REMAINS = (
    rf"(?:…|\.\.\.|[\[(<])[^.\[(<]{{0,40}}\b(?:{_REMARK})\b[^.\])>]{{0,30}}[\])>]?",
    r"[\[(]?(?:…|\.\.\.)[\])]?",
    r"\ufffd++",
    r"</?(?:[A-Za-z][^<>]{0,40})?",
    r"&#?\w{0,8}",
    r"[,:;=–-]",
)
_STRIPPED = rf"(?i)(?:{'|'.join(_REMAINS)})(?:[\s\"”]*(?:{'|'.join(_REMAINS)}))*[\s\"”]*$"
_VISIBLE = rf"{_STRIPPED}|[(\[][^()\[\]]{{0,120}}$"  # an open bracket stays: its words are counted
_AROUND = " \t\n\v\f\r\u00a0\u200b\"“”«»"
_TAIL = 500  # characters at the end in which notes and remains are looked for
LEVELS = ("trigram", "pair", "stem", "place", "word", "behind", "rate")


def _clean(text: Column) -> Column:
    """Markup and quotes around the whole text removed, entities replaced."""
    t = F.when(text.rlike("[<&]"), F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"</?[A-Za-z][^<>]{0,200}>", " "), "&amp;", "&"), r"&#?\w{1,8};", " ")).otherwise(text)
    return F.btrim(t, F.lit(_AROUND))


_BRACKETED, _WORD = r"[(\[][^()\[\]]{0,200}[)\]]", r"[\p{L}\p{M}0-9]++(?:[.,:/-][0-9][\p{L}0-9]*+|-\p{L}++[0-9][\p{L}0-9]*+)*+"


def _words(clean: Column) -> Column:
    """Lower-case words with | for a sentence end and # for whatever has a digit; addresses left out.

    The words of brackets come first, between ( and ), so that what is around a bracket is counted as if it were not there;
    a bracket left open stays where it is.
    """
    pieces = F.regexp_extract_all(F.lower(clean), F.lit(rf"https?://\S+|{_WORD}|{_BRACKETED}|[.!?]++(?=\s|$)|[(\[]"), F.lit(0))
    first = lambda x: F.left(x, F.lit(1))
    closed = lambda x: first(x).isin("(", "[") & (F.length(x) > 1)
    kind = lambda x: F.when(closed(x), "").when(first(x).isin(".", "!", "?"), "|").when(x == "[", "(").when(x.contains("://"), "").otherwise("#")
    within = F.regexp_extract_all(F.array_join(F.filter(pieces, closed), " "), F.lit(rf"{_WORD}|[()\[\]]"), F.lit(0))
    held = lambda x: F.when(x == "[", "(").when(x == "]", ")").when(x.rlike("[0-9]"), "#").otherwise(x)
    plain = lambda x: F.when(x.rlike("[^\\p{L}\\p{M}]"), kind(x)).otherwise(x)
    return F.concat(F.transform(within, held), F.array(F.lit("|")), F.array_remove(F.transform(pieces, plain), ""))


def judged(texts: DataFrame, text: str, record_id: str, source: str, least_words: int = 12, least_seen: int = 3, terminal_share: float = 0.05, word_share: float = 0.5, pile: int = 8, pile_factor: float = 4.0) -> DataFrame:
    """(id, source, reason): each judged text; ``reason`` is NULL for a complete one, else the level that told.

    ``least_seen`` is the support below which counts say nothing, ``terminal_share`` the share of terminal uses under
    which a context counts as never terminal (``word_share`` for a last word alone, which says less), ``pile`` and
    ``pile_factor`` what makes a pile of equal lengths against the 20 lengths on either side.
    """
    base = texts.select(F.col(record_id).alias("id"), F.col(source).alias("source"), F.length(text).alias("len"), _clean(F.col(text)).alias("c"), is_filler(F.col(text)).alias("filler"))
    base = base.filter(F.col("c").isNotNull() & ~F.col("filler")).withColumn("tail", F.right("c", F.lit(_TAIL)))
    ended = F.right("tail", F.lit(4)).rlike(r"[^.…][.!?][\"'’”»)\]]*$")
    base = base.withColumn("remains", ~ended & F.col("tail").rlike(_VISIBLE))
    end = F.when(F.col("remains"), F.rtrim(F.regexp_replace("tail", _STRIPPED, ""))).otherwise(F.col("tail"))
    low = F.lower("tail")
    noted = reduce(Column.__or__, (low.contains(n) for n in _NOTES))
    base = base.withColumn("end", F.when(noted, F.rtrim(F.regexp_replace(end, _NOTE, ""))).otherwise(end))
    stopped = ~F.col("remains") & ((F.length("end") < F.length("tail")) | F.right("tail", F.lit(20)).rlike(r"[.!?][\"'’”»)\]]*$"))
    complete = F.right("end", F.lit(20)).rlike(r"[.!?)\]][\"'’”»)\]]*$")
    head = base.select(
        "id", "source", "len", stopped.alias("stopped"), complete.alias("complete"), (F.col("remains") | F.col("c").rlike(r"^[\[(]?(?:…|\.\.\.)")).alias("seen"),
        F.array_join(_words(F.concat(F.left("c", F.length("c") - _TAIL), F.col("end"))), " ").alias("s"),
    )
    count = lambda mark: F.length("s") - F.length(F.replace("s", F.lit(mark), F.lit("")))
    head = head.withColumn("ends", count("|") - 1).withColumn("places", count(" "))
    head = materialise(head.withColumn("long", F.col("places") >= least_words))
    w = head.filter("long").withColumn("w", F.split("s", " "))

    # every position of every text, in each of its contexts
    following = F.get("w", F.col("i"))
    at = w.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i")).filter(F.get("w", F.col("i") - 1) != "|")
    at = at.select(
        F.explode(_contexts(F.col("i"))).alias("k"),
        F.when(following != "|", 1).otherwise(0).alias("inside"),
        F.when(following == "|", 1).otherwise(0).alias("ended"),
    )
    counts = at.groupBy("k").agg(F.sum("inside").alias("inside"), F.sum("ended").alias("ended"))
    total = F.col("inside") + F.col("ended")
    counts = materialise(counts.filter(total >= least_seen).select("k", "ended", total.alias("total"), total.alias("size")))  # the others say nothing

    opened = w.filter(~F.col("complete") & (F.element_at("w", -1) != "|")).select("id", "w")
    asked = opened.select("id", F.posexplode(_contexts(F.size("w"))).alias("level", "k"))
    share = F.when(F.col("level") < 3, terminal_share).otherwise(word_share)  # trigram, pair, place
    told = F.col("ended") < share * F.col("total")
    told = F.when(F.col("level") == 2, F.when(told, True)).otherwise(told)  # where sentences may end, a place says nothing
    levels = ("trigram", "pair", "place", "word", "behind")
    met = skew_safe_left_join(asked, counts, "k", F.xxhash64("id", "level"), "size").withColumn("told", told)
    met = met.groupBy("id").agg(*(F.max(F.when(F.col("level") == n, F.col("told"))).alias(c) for n, c in enumerate(levels)))
    ends, places = head.filter("long").agg(F.sum("ends"), F.sum("places")).first()  # how often any word ends a sentence
    met = met.withColumn("rate", F.lit((ends or 0) < word_share * (places or 1)))
    met = met.join(_stems(w, opened, terminal_share, least_seen), "id", "left")
    first = F.coalesce(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("level"), F.col(c).alias("cut"))) for c in LEVELS))
    met = met.select("id", first.alias("told"))

    lengths = head.filter("long").groupBy("source", "len").agg(F.count("*").alias("n"))
    near = lengths.select("source", F.explode(F.sequence(F.col("len") - 20, F.col("len") + 20)).alias("len"), F.col("n").alias("m"))
    near = near.groupBy("source", "len").agg(F.sum("m").alias("around"))
    usual = (F.col("around") - F.col("n")) / 40
    piles = lengths.filter(F.col("n") >= pile).join(near, ["source", "len"]).filter(F.col("n") > pile_factor * usual + 3 * F.sqrt(usual + 1))
    piles = piles.select(F.col("source").alias("ps"), F.col("len").alias("pl"), F.lit(True).alias("piled"))

    out = head.select("id", "source", "len", (F.col("stopped") | ~F.col("long")).alias("stopped"), "seen").join(met, "id", "left").join(piles, (F.col("source") == F.col("ps")) & (F.col("len") == F.col("pl")), "left")
    return out.select("id", "source", F.coalesce(F.when(F.col("told.cut"), F.col("told.level")), F.when(F.col("seen"), "mark"), F.when(F.col("piled") & ~F.col("stopped"), "length")).alias("reason"))


def _contexts(i: Column) -> Column:
    """Hashes of the contexts of the word of ``w`` at position ``i`` (from 1); places before the start count as empty."""
    back = lambda n: F.when(i > n, F.get("w", i - 1 - n)).otherwise("")
    none = F.lit("")
    return F.array(F.xxhash64(back(2), back(1), back(0)), F.xxhash64(back(1), back(0)), F.xxhash64(F.lit("place"), back(2), back(1), none), F.xxhash64(back(0)), F.xxhash64(F.lit("behind"), back(1), none, none))


def _stems(w: DataFrame, opened: DataFrame, share: float, least_seen: int, longest: int = 40) -> DataFrame:
    """(id, stem): TRUE for each text whose last word, of ``longest`` letters at most, is far more often the beginning of longer words."""
    words = materialise(w.select(F.explode("w").alias("word")).filter(~F.col("word").isin("|", "#", "(", ")")).groupBy("word").agg(F.count("*").alias("n")))
    last = opened.select("id", F.element_at("w", -1).alias("word"))
    begins = F.transform(F.sequence(F.lit(1), F.least(F.length("word") - 1, F.lit(longest))), lambda n: F.left("word", n))
    longer = words.filter(F.length("word") > 1).select(F.explode(begins).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("longer"))
    told = last.select("word").distinct().join(longer, "word").join(words, "word", "left").withColumn("own", F.coalesce("n", F.lit(0)))
    told = told.filter((F.col("longer") >= least_seen) & (F.col("own") < share * (F.col("own") + F.col("longer"))))
    return skew_safe_left_join(last, told.select("word", F.lit(True).alias("stem"), F.col("longer").alias("size")), "word", F.col("id"), "size").select("id", "stem")


def rates(verdicts: DataFrame) -> DataFrame:
    """(source, texts, cut, rate) over single source names: a record of several sources counts for each."""
    each = verdicts.select(F.explode(F.split(F.coalesce("source", F.lit("")), r"\s*,\s*")).alias("source"), F.col("reason").isNotNull().cast("long").alias("cut"))
    out = each.groupBy("source").agg(F.count("*").alias("texts"), F.sum("cut").alias("cut"))
    return out.select("source", "texts", "cut", F.round(F.col("cut") / F.col("texts"), 6).alias("rate"))


def found(papers: DataFrame) -> DataFrame:
    """(paper_id) of each paper whose abstract is cut."""
    return judged(papers, "abstract", "paper_id", "source").filter("reason IS NOT NULL").select(F.col("id").alias("paper_id"))
