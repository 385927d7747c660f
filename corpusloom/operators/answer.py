"""Context assembly, routing and generation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.tokens import contains_any

#: Least similarity of context, longest context, shortest remainder worth adding.
RELEVANT, MAX_CHARS, MIN_REST = 0.40, 3000, 100
MODES = ("OUT OF SCOPE", "GENERAL KNOWLEDGE", "DATABASE RAG")


def context_part(no: Column, label: Column, score: Column, text: Column) -> Column:
    return F.concat(F.lit("[Konteks "), no.cast("string"), F.lit("]\nSumber   : "), label, F.lit("\nRelevansi: "), F.format_string("%.2f", score), F.lit("\n---\n"), text)


def context_budget(parts: DataFrame, *, query_id: str = "query_id", order: str = "place", part_col: str = "part", max_chars: int = MAX_CHARS, min_rest: int = MIN_REST) -> DataFrame:
    """The parts that fit one after the other, the first that doesn't cut to the rest
    if that is over ``min_rest``: (query, order, part)."""
    w = Window.partitionBy(query_id).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("__sum") - F.length(part_col)
    fits, cut = F.col("__sum") <= max_chars, (before <= max_chars) & (F.lit(max_chars) - before > min_rest)
    part = F.when(fits, F.col(part_col)).when(cut, F.concat(F.substring(F.col(part_col), F.lit(1), (F.lit(max_chars) - before).cast("int")), F.lit("...")))
    return parts.withColumn("__sum", F.sum(F.length(part_col)).over(w)).withColumn(part_col, part).filter(F.col(part_col).isNotNull()).select(query_id, order, part_col)


def format_context(parts: DataFrame, *, query_id: str = "query_id", order: str = "place", part_col: str = "part") -> DataFrame:
    """One context string a query: its parts in order, under a leading blank line."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, part_col))), lambda s: s[part_col]), "=" * 40 + "\n\n")
    return parts.groupBy(query_id).agg(F.concat(F.lit("\n\n"), joined).alias("context"))


def out_of_scope(query: Column, out_terms: Sequence[str], in_terms: Sequence[str]) -> Column:
    low = F.lower(query)
    return contains_any(low, out_terms) & ~contains_any(low, in_terms)


def route(n_relevant: Column, outside: Column) -> Column:
    return F.when(n_relevant > 0, MODES[2]).when(outside, MODES[0]).otherwise(MODES[1])


#: Our own wording; a caller may give another.
SYSTEM = "You answer questions on one subject from the passages that come with them. Keep to what they say, name the source of each statement, and say so when they are not enough."


def build_prompt(mode: Column, query: Column, context: Column, *, system: str = "") -> Column:
    """The prompt of a question by its mode, behind the ``system`` prompt, if there is one."""
    asked = F.concat(F.lit("\nQuestion: "), query)
    lead = F.lit(f"{system}\n\n" if system else "")
    return F.concat(
        lead,
        F.when(mode == MODES[0], F.concat(F.lit(f"[MODE: {MODES[0]}]"), asked, F.lit("\nSay kindly that the question lies outside the subject, and offer to help within it.")))
        .when(mode == MODES[1], F.concat(F.lit(f"[MODE: {MODES[1]}]"), asked, F.lit("\nThe corpus holds nothing on this. Answer from general knowledge and mark it as such.")))
        .otherwise(F.concat(F.lit(f"[MODE: {MODES[2]}]\n"), F.coalesce(context, F.lit("")), asked, F.lit("\nAnswer from the context and name the source of each statement."))),
    )


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]:
        """One answer a prompt; called on the executors."""
        ...


class ExtractiveGenerator:
    """Stands in for a language model: the first lines of the context, or the mode."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [p.split("---\n", 1)[1].split("\n", 1)[0] if "---\n" in p else p[max(0, p.find("[MODE:")) :].split("\n", 1)[0] for p in prompts]


class ChatGenerator:
    """A chat model behind a client that ``connect`` makes on the executors, once to a
    Python worker: ``client(messages, model=, temperature=, max_tokens=)`` gives a text.
    Keys belong in the configuration that ``connect`` reads, never in here."""

    def __init__(self, connect, model: str, *, system: str = SYSTEM, temperature: float = 0.5, max_tokens: int = 4096) -> None:
        self.connect, self.model, self.system = connect, model, system
        self.options = {"temperature": temperature, "max_tokens": max_tokens}

    def generate(self, prompts: list[str]) -> list[str]:
        client = _client(self.connect)
        return [client([{"role": "system", "content": self.system}, {"role": "user", "content": p}], model=self.model, **self.options) for p in prompts]


@cache
def _client(connect):
    return connect()


def generate(prompts: DataFrame, generator: Generator | None, prompt_col: str = "prompt", batch_size: int = 32) -> DataFrame:
    """``prompts`` with ``response`` and ``ok``. A failure becomes the text of its row's
    response; the job goes on."""
    fields = [f for f in prompts.schema.fields if f.name not in ("response", "ok")]

    names = [*(f.name for f in fields), "response", "ok"]

    def answers(part: list[str]) -> list[tuple[str, bool]]:
        try:
            if generator is None:
                raise RuntimeError("the engine is not set up")
            return [(text, True) for text in generator.generate(part)]
        except Exception as e:  # noqa: BLE001  one row's trouble is that row's answer
            if len(part) == 1 or generator is None:
                return [(f"No answer: {e}", False)] * len(part)
            return answers(part[: len(part) // 2]) + answers(part[len(part) // 2 :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(at_prompt).to_pylist()
            found = [x for at in range(0, len(asked), batch_size) for x in answers(asked[at : at + batch_size])]
            texts, fine = [t for t, _ in found], [ok for _, ok in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(fine, pa.bool_())], names=names)

    at_prompt = names.index(prompt_col)
    return prompts.select(*[f"`{f.name}`" for f in fields]).mapInArrow(run, T.StructType([*fields, T.StructField("response", T.StringType()), T.StructField("ok", T.BooleanType())]))
