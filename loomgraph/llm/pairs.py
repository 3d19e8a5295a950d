"""Defective prompt and response pairs: empty, truncated, refusal, copy, other language."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut_lineage

# Fixed values, all compared in lower case.

#: What says nothing, as its letters and digits only.
EMPTY_FORMS = [
    "", "na", "none", "null", "nil", "nan", "empty", "noanswer", "noresponse", "noreply", "tbd", "tba", "unknown", "undefined", "blank",
    "answer", "response", "reply", "a", "antwort", "réponse", "reponse", "respuesta", "回答", "答案",
]

#: What may stand around a repeated question, as its letters only.
COPY_FRAME = "(?:you asked|your question|the question(?: is| was)?|question|answer|q|a|vous avez demandé|votre question|ihre frage|du hast gefragt|sie fragten|frage|antwort|tu pregunta|preguntaste|pregunta|respuesta|réponse|你问|问题|问|答)"

#: Polite openings before a refusal.
POLITE = (
    r"(?:(?:thank you|thanks)(?: very much| so much)?(?: for [^.,!]*)?|h+m+|well|(?:i am |i'm )?(?:very |so )?sorry(?= - | \.)|merci(?: beaucoup)?(?: pour [^.,!]*)?|(?:vielen )?danke?(?: schön)?(?: für [^.,!]*)?"
    r"|(?:muchas )?gracias(?: por [^.,!]*)?|感谢(?:您的?)?提问|谢谢(?:您的?)?(?:提问|问题)?)[.,!。，！…\s]+"
)

#: How an answerer declines, from the beginning of the answer.
REFUSALS = [
    r"(?:i am|i'm|we are|we're) (?:so |very |really )?sorry,? (?:but )?(?:i|we) (?:can't|cannot|can not|am unable|are unable|won't|am not able|don't|do not)",
    r"(?:unfortunately|regrettably|sorry),? (?:but )?(?:i|we) (?:can't|cannot|can not|am unable to|are unable to|won't|am not able to|don't have|do not have|must decline)",
    r"sorry,? (?:but )?(?:that|this|your) (?:request|question)",
    r"(?:i am|i'm|we are|we're) (?:unable|not able|not allowed|not permitted|not in a position) to (?:answer|help|assist|respond|provide|give|discuss|share|comply|complete)",
    r"(?:i|we) (?:must|have to|will have to|would rather|prefer to) (?:decline|refuse|not answer)(?: to (?:answer|respond|help|comment)| this| that| the request)?[.!]",
    r"(?:i|we) (?:can't|cannot|can not|won't|will not|do not|don't|could not) (?:be able to )?(?:assist|help|answer|provide|give you|respond|share|complete|comply|discuss)",
    r"as an? (?:[a-z]+ )*(?:assistant|model|ai|language model),? (?:i|we) (?:can't|cannot|can not|am unable|am not|must|won't|do not|don't)",
    r"(?:my|our) apologies\b",
    r"no answer can be (?:given|provided)",
    r"it (?:would|is) not (?:be )?(?:appropriate|possible) for me to",
    r"(?:this|that|the) (?:request|question) (?:can't|cannot|can not) be (?:completed|answered|fulfilled)",
    r"je (?:suis )?(?:vraiment )?(?:désolée?|regrette),?(?: mais)? je ne (?:peux|puis|suis)",
    r"il m'est impossible de", r"je préfère ne pas", r"je ne (?:peux|puis) pas (?:répondre|aider|vous aider|fournir)", r"je dois (?:décliner|refuser)", r"en tant qu'assistante?,",
    r"(?:diese|die|ihre) (?:frage|anfrage|bitte) (?:kann|darf) ich", r"es tut mir leid,? (?:aber )?(?:dabei|damit|da|das|ich) (?:kann|darf)", r"dazu (?:darf|kann) ich (?:keine|nicht|nichts)",
    r"leider (?:kann|darf) ich", r"ich (?:kann|darf|möchte) (?:diese|die|ihre|darauf|dazu|hierzu)[^.]* nicht", r"als assistent(?:in)?",
    r"lo siento,? (?:pero )?no (?:puedo|me es)", r"no me es posible", r"prefiero no (?:contestar|responder)", r"no puedo (?:ayudar|responder|contestar|proporcionar)", r"como asistente,",
    r"(?:抱歉|对不起|很抱歉|很遗憾|不好意思)[，,]?我?(?:无法|不能|不便|没法)", r"作为(?:一个|一名)?(?:ai|人工智能)?助手[，,]?我?(?:无法|不能|不便)", r"我(?:无法|不能|不便)(?:回答|提供|协助|帮助)",
]

#: Function words, by which texts are found that show what a language looks like.
FUNCTION_WORDS = {
    "en": "the a an of and to in was were is are had has have not this with on at by for from as but who what where when why how did do does which".split(),
    "fr": "le la les un une des du de et est était l d qu que qui ne pas sans où je à au aux ce cette dans avec pour sur par il elle avait".split(),
    "de": "der die das den dem des ein eine einen und ist war nicht mit auf an am im zum zur von wo wer was wie warum nach vor hatte habe ich".split(),
    "es": "el la los las un una de del y es era no con sin en al que quién qué dónde cómo por para su se lo había estaba".split(),
}

_BLANK = r"[\s\p{Z}​‌‍﻿]+"
_ENDED = "[.!?。！？][\"'”’»“)\\]」』]*$"
_DOTS = "(?:\\.\\.|…)[\"'”’»“)\\]」』]*$"
_CUT_MARK = r"(?i)\[\s*(?:\.\.\.|…|truncated|cut|snip(?:ped)?|omitted|content omitted|abridged|gekürzt|tronqué|coupé|truncado|cortado|截断|省略)[^\]]{0,20}\]"
_LIST = r"(?s)^(?:[-*•]|\d+[.)])\s"
_BARE_ITEM = r"\n\s*(?:\d+[.)]|[-*•])$"
_LETTERS = re.compile(r"[^\W\d_]+")
LEAST_ODDS = 8.0  # log odds over the next language from which a text's language is told
FEWEST_WORDS = 4  # names and numbers, which have no language, are shorter


def bare(c: Column) -> Column:
    """Without blanks and invisible characters at the ends."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"^{_BLANK}|{_BLANK}$", "")


def letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def unended(c: Column) -> Column:
    return ~c.rlike(_ENDED) | c.rlike(_DOTS)


def _words(text: str | None) -> list[str]:
    return _LETTERS.findall(re.sub(r"\[[A-Z_]+\]", " ", text or "").lower())


def is_han(text: str | None) -> bool:
    han = len(re.findall("[一-鿿]", text or ""))
    return han > 0 and han * 3 > sum(map(len, _LETTERS.findall(re.sub(r"\[[A-Z_]+\]|[一-鿿]", " ", text or ""))))


def _grams(words: list[str]) -> list[str]:
    return [f" {w} "[i : i + 3] for w in words for i in range(len(w))]


def language_profiles(texts: DataFrame) -> dict[str, dict[str, float]]:
    """The log share of each character trigram in each language, counted over all of ``text``.

    A text counts for a language if it has two or more of its function words and
    more than of any other's.  Trigrams seen once are left to the smoothing.
    What reaches the driver are trigrams of letters, as many as languages have.
    """
    sets = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {k: Counter() for k in sets}
        for pdf in batches:
            for text in pdf["text"]:
                words = _words(text)
                n = sorted(((sum(w in v for w in words), k) for k, v in sets.items()), reverse=True)
                if n[0][0] >= 2 and n[0][0] > n[1][0] and not is_han(text):
                    seen[n[0][1]].update(_grams(words))
        yield pd.DataFrame([(k, g, c) for k, v in seen.items() for g, c in v.items()], columns=["lang", "gram", "n"])

    rows = texts.select("text").mapInPandas(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1").collect()
    out: dict[str, dict[str, float]] = {k: {} for k in sets}
    for r in rows:
        out[r["lang"]][r["gram"]] = r["n"]
    for k, v in out.items():
        total = sum(v.values()) + 2000
        out[k] = {g: math.log((c + 0.5) / total) for g, c in v.items()} | {"": math.log(0.5 / total)}
    return {k: v for k, v in out.items() if len(v) > 1}


def language_of(text: str | None, profiles: dict[str, dict[str, float]]) -> str | None:
    """'zh' by its characters, else the language whose trigrams fit clearly best, else None."""
    if is_han(text):
        return "zh"
    words = _words(text)
    if len(words) < FEWEST_WORDS:
        return None
    grams = _grams(words)
    odds = sorted(((sum(v.get(g, v[""]) for g in grams), k) for k, v in profiles.items()), reverse=True)
    return odds[0][1] if len(odds) > 1 and odds[0][0] - odds[1][0] >= LEAST_ODDS else None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours in sorted order: the texts that the next one continues inside a word, and both ends of the partition."""
    context = TaskContext.get()
    at = context.partitionId() if context else 0
    prev = None
    for batch in batches:
        found = []
        for text in batch.column(0).to_pylist():
            if prev is None:
                found.append((at, 0, text))
            elif text.startswith(prev) and _inside_word(prev, text):
                found.append((at, 2, prev))
            prev = text
        yield _rows(found)
    if prev is not None:
        yield _rows([(at, 1, prev)])


def _inside_word(short: str, long: str) -> bool:
    a, b = short[-1:], long[len(short) : len(short) + 1]
    return a.isalnum() and b.isalnum() and not ("一" <= b <= "鿿") and " " in short


def _rows(found: list[tuple[int, int, str]]) -> pa.RecordBatch:
    at, kind, text = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(kind, pa.int32()), pa.array(text, pa.string())], names=["at", "kind", "text"])


def shortened_versions(texts: DataFrame) -> DataFrame:
    """Those of the distinct ``text`` of two or more words that another one continues inside a word.

    The texts are range-partitioned and sorted, so that the continuation of a
    text is its next neighbour; one that goes on after a whole word, which
    speaks against a cut, sorts before one that goes on inside it.  The two ends
    of each partition (rows as many as partitions) are compared apart.
    """
    ordered = texts.repartitionByRange("text").sortWithinPartitions("text")
    runs = cut_lineage(ordered.mapInArrow(_runs, "at int, kind int, text string"), "runs")
    inner = runs.where("kind = 2").select("text")
    nxt = F.lead("text").over(Window.orderBy("at", "kind"))
    ends = runs.where("kind < 2").withColumn("next", nxt).where("kind = 1 and next is not null")
    goes_on = F.expr("startswith(next, text) and substring(next, length(text) + 1, 1) rlike '[\\\\p{L}\\\\p{N}&&[^\\\\p{IsHan}]]' and text rlike ' ' and text rlike '[\\\\p{L}\\\\p{N}]$'")
    return inner.unionByName(ends.where(goes_on).select("text")).distinct()


def length_spikes(responses: DataFrame, sigmas: float = 6.0, width: int = 10) -> DataFrame:
    """Lengths at which responses without an end pile up: ``n_chars``.

    A length counts if its unended responses exceed the mean of the lengths
    within ``width`` of it by ``sigmas`` times the spread a count of that mean
    has by chance; so the rule is the same for a table of any size.
    """
    hist = responses.where(unended(F.col("text"))).groupBy(F.length("text").alias("n_chars")).agg(F.count(F.lit(1)).alias("n"))
    near = Window.orderBy("n_chars").rangeBetween(-width, width)  # one row a length
    others = (F.sum("n").over(near) - F.col("n")) / (2 * width)
    return hist.withColumn("others", others).where(F.col("n") > F.col("others") + sigmas * F.sqrt(F.col("others") + 1)).select("n_chars")


def find_defects(pairs: DataFrame, key: str, prompt: str, response: str) -> DataFrame:
    """``key, defect`` of each defective pair, once.

    A response is 'empty' if it has no letters or digits but those of a
    stand-in; 'copy' if it has nothing but the prompt, perhaps repeated or
    announced; 'refusal' if, after politeness, it begins by declining in the
    answerer's own voice (quotations do not count); 'other_language' if prompt
    and response are told to be of two languages; 'truncated' if a part is
    marked as cut, a list stops at an item without text, or it does not end as a
    sentence does, unless it is a short answer without any sentence or a list;
    these, too, are truncated if another response continues them inside a word
    or their length is one where unended responses pile up.  In this order the
    first counts.

    A null response is empty; a null or empty prompt can be neither copied nor
    of another language; repeated rows give one row; rows with a null key give
    none; very long texts are treated whole; an empty table gives none; other
    columns are ignored.
    """
    said, asked = letters(F.col("text")), letters(F.col("prompt"))
    rows = pairs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(prompt), F.lit("")).alias("prompt"), bare(F.col(response)).alias("text"))
    profiles = rows.sparkSession.sparkContext.broadcast(language_profiles(rows.select(F.explode(F.array("prompt", "text")).alias("text"))))

    def languages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, str | None] = {}  # prompts recur
        for pdf in batches:
            if len(known) > 100_000:
                known.clear()
            asked_in = [known[p] if p in known else known.setdefault(p, language_of(p, profiles.value)) for p in pdf["prompt"]]
            said_in = [language_of(t, profiles.value) for t in pdf["text"]]
            yield pdf.assign(foreign=[a is not None and b is not None and a != b for a, b in zip(asked_in, said_in)])

    # what a row shows by itself
    text, low = F.col("text"), F.lower(F.col("text"))
    empty = said.isin(EMPTY_FORMS)
    around = F.trim(F.regexp_replace(F.lower(F.replace(letters_spaced(text), F.ltrim(letters_spaced(F.col("prompt"))), F.lit(" "))), r"[^\p{L}\p{N}]+", " "))
    copy = (asked != "") & F.contains(said, asked) & around.rlike(f"^(?:{COPY_FRAME}(?: |$))*$")
    refusal = low.rlike(f"^(?:{POLITE})*(?:{'|'.join(REFUSALS)})")
    # a word or two, or a list of names, needs no full stop
    has_sentence = F.regexp_replace(text, r"(?s).$", "").rlike("[.!?。！？]") | text.rlike("[:：,，;；]$")
    short = ~has_sentence & (F.size(F.split(text, r"\s+")) <= 6) & (F.length(F.regexp_replace(text, r"[^一-鿿]", "")) <= 12)
    is_list = text.rlike(_LIST)
    cut_off = text.rlike(_CUT_MARK) | (is_list & text.rlike(_BARE_ITEM)) | (unended(text) & ~short & ~is_list)
    own = F.when(empty, "empty").when(copy, "copy").when(refusal, "refusal").when(F.col("foreign"), "other_language").when(cut_off, "truncated")
    judged = rows.mapInPandas(languages, "key string, prompt string, text string, foreign boolean").select("key", "text", own.alias("defect"))
    judged = cut_lineage(judged, "judged")
    found = judged.where("defect is not null").select("key", "defect")

    # what only the other responses show of short answers and lists
    open_ = judged.where(F.col("defect").isNull() & unended(text)).select("key", "text", F.xxhash64("text").alias("h"), F.length("text").alias("n_chars"))
    spikes = length_spikes(judged.where("text <> ''").select("text").distinct())
    cut = shortened_versions(judged.where("text <> ''").select("text").distinct()).where(unended(text)).select(F.xxhash64("text").alias("h"), F.col("text").alias("cut"))
    by_length = open_.join(spikes, "n_chars", "left_semi").where(~short)
    continued = open_.join(cut, (open_["h"] == cut["h"]) & (F.col("text") == F.col("cut")), "left_semi")
    late = by_length.select("key").unionByName(continued.select("key")).select("key", F.lit("truncated").alias("defect"))
    return found.unionByName(late).distinct().select(F.col("key").alias(key), "defect")


def letters_spaced(c: Column) -> Column:
    """Words in lower case with one blank between them, and one at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
