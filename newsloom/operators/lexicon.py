"""Lexicons of any size, as tables, matched against texts in one pass.

All phrases of a lexicon make one automaton, which reads a folded text once and names every phrase that ends at each
letter; the cost of a text doesn't grow with the number of phrases. Texts are folded in the JVM and come in Arrow batches.
A table of more phrases than one automaton should hold is dealt into several, and the texts are read once for each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import classify

#: Phrases of one automaton.
MOST = 200_000


@lru_cache(1 << 16)
def in_word(letter: str) -> bool:
    """Whether a letter is part of a word, as in regular expressions over Unicode."""
    return unicodedata.category(letter) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Nd", "Mn", "Mc", "Me", "Pc")


class Phrases:
    """Folded phrases with a number each; ``whole`` ones count between non-word letters only."""

    def __init__(self, phrases: list[tuple[str, bool]]):
        self.automaton, self.whole = ahocorasick.Automaton(), [w for _, w in phrases]
        numbers: dict[str, list[int]] = {}
        for i, (phrase, _) in enumerate(phrases):
            if phrase:
                numbers.setdefault(phrase, []).append(i)
        for phrase, own in numbers.items():
            self.automaton.add_word(phrase, (len(phrase), own))
        self.any = bool(numbers)
        if self.any:
            self.automaton.make_automaton()

    def counts(self, text: str) -> dict[int, int]:
        """How often each phrase is in a text; a phrase doesn't overlap itself."""
        found: dict[int, int] = {}
        after: dict[int, int] = {}
        if not self.any or not text:
            return found
        for end, (length, own) in self.automaton.iter(text):
            begin = end - length + 1
            bounded = None
            for i in own:
                if begin < after.get(i, 0):
                    continue
                if self.whole[i]:
                    if bounded is None:
                        bounded = not (begin and in_word(text[begin - 1])) and not (end + 1 < len(text) and in_word(text[end + 1]))
                    if not bounded:
                        continue
                found[i] = found.get(i, 0) + 1
                after[i] = end + 1
        return found


def mentions(texts: DataFrame, key: str, text: Column, phrases: DataFrame, phrase: str = "phrase", most: int = MOST) -> DataFrame:
    """key, the columns of phrases, n: how often each phrase stands in each folded text between non-word letters, where it does.

    text: a folded column. Phrases are folded here; null and empty ones, and null texts, mention nothing.
    """
    n = phrases.count()
    parts = max(1, -(-n // most))
    clean = phrases.withColumn("_folded", T.normalized(F.col(phrase))).where("_folded <> ''")
    out = None
    for part in range(parts):
        own = clean.where(F.pmod(F.xxhash64("_folded"), F.lit(parts)) == part).select("_folded").distinct().toPandas()["_folded"].tolist()  # at most about ``most``

        def counted(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            automaton = Phrases([(p, True) for p in own])
            for batch in batches:
                rows, numbers, counts = [], [], []
                for i, one in enumerate(batch.column(1).to_pylist()):
                    for number, count in automaton.counts(one or "").items():
                        rows.append(i)
                        numbers.append(own[number])
                        counts.append(count)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.string()), pa.array(counts, pa.int64())], [key, "_folded", "n"])

        found = texts.select(key, text.alias("_text")).mapInArrow(counted, f"`{key}` {texts.schema[key].dataType.simpleString()}, _folded string, n long")
        out = found if out is None else out.unionByName(found)
    told = F.broadcast(clean) if n <= most else clean
    return out.join(told, "_folded").drop("_folded")


def entities(texts: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """key, type, name, mentions, confidence of each entity that a text mentions. lexicon: type, name, alias, confidence; mentions of all aliases add up."""
    found = mentions(texts, key, T.normalized(F.col(text)), lexicon.select("type", "name", "confidence", "alias").distinct(), "alias")
    return found.groupBy(key, "type", "name").agg(F.sum("n").alias("mentions"), F.max("confidence").alias("confidence"))


def topics(df: DataFrame, category: str, title: str, summary: str, content: str, keywords: DataFrame, aliases: DataFrame | None = None, locks: DataFrame | None = None) -> DataFrame:
    """Like classify.topics, with lexicons as tables. keywords: topic, place (the topic's precedence), keyword; aliases, locks: alias, place, topic.

    The rules of a topic lexicon are bounded by what one automaton holds (MOST rows each); more are refused.
    """
    def pairs(table: DataFrame | None, name: str) -> list[tuple[str, str]]:
        if table is None:
            return []
        rows = table.orderBy("place", name).select(T.normalized(F.col(name)).alias("phrase"), "topic").limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise ValueError(f"a topic lexicon holds at most {MOST} rows")
        return [(r.phrase, r.topic) for r in rows]

    words, named, locked = pairs(keywords, "keyword"), pairs(aliases, "alias"), pairs(locks, "alias")
    order = list(dict.fromkeys(t for _, t in words))
    place = {t: i for i, t in enumerate(order)}
    fields = [f"_field{i}" for i in range(4)]
    kept = df.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = lambda p: (p, len(p) <= 3)
        all_words, all_names, all_locks = (Phrases([short(p) for p, _ in x]) for x in (words, named, locked))
        for batch in batches:
            texts = [batch.column(len(kept) + i).to_pylist() for i in range(4)]
            out = []
            for row in zip(*texts, strict=True):
                scores = [0.0] * len(order)
                for one, weight in zip(row, classify.FIELD_WEIGHTS, strict=True):
                    for i in all_words.counts(one):
                        scores[place[words[i][1]]] += weight
                for automaton, rules, weight in ((all_names, named, classify.ALIAS_WEIGHT), (all_locks, locked, classify.LOCK_WEIGHT)):
                    first = min(automaton.counts(row[0]), default=None)
                    if first is not None and rules[first][1] in place:
                        scores[place[rules[first][1]]] += weight
                out.append(scores)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.list_(pa.float64()))], [*kept, "_scores"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _scores array<double>"
    made = df.select("*", *(T.normalized(F.col(c)).alias(f) for c, f in zip((category, title, summary, content), fields, strict=True))).mapInArrow(scored, schema)
    structs = [F.struct((-F.col("_scores")[i]).alias("neg"), F.lit(i).alias("order"), F.lit(t).alias("topic")) for i, t in enumerate(order)]
    return classify.decided(made.withColumn("_s", F.array_sort(F.array(*structs))), kept, len(order), F.array().cast("array<string>"))
