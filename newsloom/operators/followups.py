"""Follow-up questions resolved against what a conversation showed before.

What a question says by itself (a citation's number, a reference to "this article", its content words, its intent) is
told by column expressions. What it refers to depends on the turns before: the sources of the last answer and the one that
was chosen from them. That state is small whatever the conversation's length. Tables are dealt by conversation, sorted by turn
and read once, with the state of one conversation at a time; streams keep the same state by conversation.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T

#: Patterns of a citation's number, in order, on normalised text.
CITATIONS = (r"\[(\d{1,2})\]", r"(?:nguon|source)\s*(?:so)?\s*(\d{1,2})", r"(?:bai\s+bao|article)\s*(?:so)?\s*(\d{1,2})", r"(?:bai|tin)\s*(?:so)?\s*(\d{1,2})")
#: Phrases that refer to a source shown before.
REFERENCES = ("bai nay", "bai do", "bai bao nay", "bai bao do", "tin nay", "tin do", "nguon nay", "nguon do", "y tren", "doan tren")
#: Words of a question that say nothing of a source's content.
STOP_TERMS = ("tom", "tat", "bai", "bao", "tin", "nguon", "source", "article", "so", "la", "gi", "noi", "dung", "nay", "do", "ve", "cua", "cho", "toi", "hay", "minh", "duoc", "khong", "co", "can")
#: Phrases of each intent; the second and third count only beside a reference or a citation's number.
SIMPLER = ("tom tat ngan hon", "noi ngan gon", "ngan gon hon", "rut gon", "viet ngan hon")
IMAGES = ("cho toi xem anh", "xem anh", "hinh anh", "anh cua")
SUMMARY = ("tom tat", "noi gi", "noi dung gi", "bai nay", "tin nay", "nguon nay")
EXPAND = ("giai thich them", "y tren", "doan tren")

SOURCE = "struct<citation_id: int, article_id: string, url: string, title: string, snippet: string, source: string, topic: string>"


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text holds one of the phrases."""
    return reduce(lambda a, p: a | text.contains(p), phrases, F.lit(False))


def citation(text: Column) -> Column:
    """The number of the source that a normalised question names; null if none."""
    return F.coalesce(*(F.try_to_number(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.lit("99")).cast("int") for p in CITATIONS))


def intent(text: Column) -> Column:
    """The kind of follow-up that a normalised question is; null if none."""
    number = citation(text).isNotNull()
    refers = any_of(text, REFERENCES) | number
    return (
        F.when(any_of(text, SIMPLER), "followup_simplify")
        .when(any_of(text, IMAGES) & refers, "followup_media_lookup")
        .when(any_of(text, SUMMARY) & refers, "followup_article_summary")
        .when(number, "followup_citation_question")
        .when(any_of(text, EXPAND), "followup_expand")
    )


def content_terms(text: Column) -> Column:
    """The words by which a question is compared with a source: three letters or more, no stop words, no numbers."""
    return F.filter(T.terms(text), lambda t: ~t.isin(*STOP_TERMS) & ~t.rlike(r"(?U)^\d+$"))


def turns(df: DataFrame, conversation: str, turn: str, role: str, text: str, sources: str) -> DataFrame:
    """What resolving needs of each turn: _c, _t, intent, cited, refers, terms (questions), shown (answers): number, address and words of each source."""
    folded = T.normalized(F.col(text))
    asked = F.col(role) == "user"

    def words(s: Column) -> Column:
        return F.concat_ws(" ", *(F.coalesce(s[f], F.lit("")) for f in ("title", "snippet", "source", "topic")))

    shown = F.transform(F.coalesce(F.col(sources), F.array().cast(f"array<{SOURCE}>")), lambda s: F.struct(s["citation_id"].alias("id"), words(s).alias("words")))
    shown = F.transform(shown, lambda s: F.struct(s["id"].alias("id"), T.terms(s["words"]).alias("terms")))
    return df.select(
        F.col(conversation).alias("_c"), F.col(turn).alias("_t"), asked.alias("asked"), F.when(asked, intent(folded)).alias("intent"), F.when(asked, citation(folded)).alias("cited"),
        F.when(asked, any_of(folded, REFERENCES)).alias("refers"), F.when(asked, content_terms(F.col(text))).alias("terms"), F.to_json(F.when(~asked, shown)).alias("shown"),
    )


class Context:
    """The sources of a conversation's last answer and the one chosen from them."""

    def __init__(self, said: str | None = None):
        self.sources, self.chosen = json.loads(said) if said else ([], None)

    def __str__(self) -> str:
        return json.dumps([self.sources, self.chosen])

    def answered(self, shown: str | None) -> None:
        """An answer with sources replaces those before; one without leaves them."""
        found = [(s.get("id"), s.get("terms", [])) for s in json.loads(shown or "[]")]
        if found:
            self.sources, self.chosen = found, None

    def resolved(self, cited: int | None, refers: bool, terms: list[str]) -> tuple[str, int | None]:
        """(source, its number), (clarify, number or none) or (none, none) for a question."""
        if not self.sources:
            return "none", None
        number = cited if cited is not None else self.chosen
        if number is not None:
            for known, words in self.sources:
                if known == number:
                    if terms and words and not set(terms) & set(words):
                        return "none", None
                    self.chosen = number
                    return "source", number
            return "clarify", number
        if not refers:
            return "none", None
        if len(self.sources) == 1:
            self.chosen = self.sources[0][0]
            return "source", self.chosen
        return "clarify", None


OUT = "intent string, status string, citation_id int"


def taken(context: Context, row) -> tuple | None:
    """The result of a question; None for an answer, which changes the context."""
    if not row.asked:
        context.answered(row.shown)
        return None
    cited = None if pd.isna(row.cited) else int(row.cited)
    return (row.intent, *context.resolved(cited, bool(row.refers), list(row.terms) if row.terms is not None else []))


def resolve(df: DataFrame, conversation: str, turn: str, role: str, text: str, sources: str) -> DataFrame:
    """conversation, turn, intent, status, citation_id of every question of a table. sources: an array of SOURCE for answers, null for none.

    status: ``source`` if the question is about source citation_id, ``clarify`` if one must be chosen (citation_id: a number
    that isn't there), ``none`` if it refers to none. Turns of equal number are in the order of their text's features. A null
    role counts as an answer, null conversations as one conversation.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    known = turns(df.withColumn(role, F.coalesce(F.col(role), F.lit("assistant"))), conversation, turn, role, text, sources)
    dealt = known.repartition("_c").sortWithinPartitions("_c", "_t", "asked", "intent", "cited", "shown")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, current = Context(), ()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = (None,) if pd.isna(row[0]) else (row[0],)
                if key != current:
                    context, current = Context(), key
                found = taken(context, row)
                if found:
                    out.append((row[0], row[1], *found))
            yield pd.DataFrame(out, columns=[conversation, turn, "intent", "status", "citation_id"]).astype({"citation_id": "Int32"})

    named = dealt.withColumnsRenamed({"_c": "c", "_t": "t"})
    return named.mapInPandas(read, f"`{conversation}` {kinds[conversation]}, `{turn}` {kinds[turn]}, {OUT}")


def resolve_stream(stream: DataFrame, conversation: str, turn: str, role: str, text: str, sources: str) -> DataFrame:
    """The same for a stream whose micro-batches hold later turns than those before; state is kept by conversation."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    known = turns(stream.withColumn(role, F.coalesce(F.col(role), F.lit("assistant"))), conversation, turn, role, text, sources).withColumnsRenamed({"_c": "c", "_t": "t"})

    def read(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        context = Context(state.get[0] if state.exists else None)
        # a conversation's turns of one micro-batch; a stream brings few at a time
        rows = pd.concat(list(batches)).sort_values(["t", "asked"], kind="stable")
        out = [(key[0], row[1], *found) for row in rows.itertuples(index=False) if (found := taken(context, row))]
        state.update((str(context),))
        yield pd.DataFrame(out, columns=[conversation, turn, "intent", "status", "citation_id"]).astype({"citation_id": "Int32"})

    return known.groupBy("c").applyInPandasWithState(read, f"`{conversation}` {kinds[conversation]}, `{turn}` {kinds[turn]}, {OUT}", "context string", "append", GroupStateTimeout.NoTimeout)
