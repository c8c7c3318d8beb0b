"""Prompts, answers and conversations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens

RULE = "=" * 80
INTRO = "These files may help to answer it:"
CLOSING = "Answer from the files above and name the places that you rely on."


def section() -> Column:
    """The text for one file (path, language, n_matches, is_partial, content)."""
    return F.concat(
        F.lit(f"{RULE}\nFile: "), "path", F.lit("\nLanguage: "), F.coalesce("language", F.lit("unknown")),
        F.when(F.col("n_matches") > 0, F.concat(F.lit("\nMatches: "), F.col("n_matches").cast("string"))).otherwise(""),
        F.when(F.col("is_partial"), F.lit("\n(parts of the file)")).otherwise(""),
        F.lit(f"\n{RULE}\n"), "content",
    )


def assembled(question: Column, keywords: Column) -> Column:
    """An aggregate: question, a section for each file by rank, keywords, closing line.
    What is packed has a bounded size, and so has the text."""
    parts = F.array_sort(F.collect_list(F.struct("rank", section().alias("text"))))
    body = F.array_join(F.transform(parts, lambda s: s["text"]), "\n\n")
    return F.concat(F.lit("Question: "), question, F.lit(f"\n\n{INTRO}\n\n"), body, F.lit("\n\nKeywords: "), keywords, F.lit(f"\n\n{CLOSING}"))


def prompt(packed: DataFrame, question: str, keywords: list[str]) -> DataFrame:
    """One row (prompt) of the packed files (rank, path, language, n_matches, is_partial, content)."""
    return packed.agg(assembled(F.lit(question), F.lit(", ".join(keywords))).alias("prompt"))


def first_section(question: str, prompt: str) -> str:
    """An answer that needs no model: the head of the best file's section."""
    parts = prompt.split(RULE)
    return parts[2].strip()[:500] if len(parts) > 2 else "Nothing was found."


def answers(prompts: DataFrame, answer: Callable[[str, str], str] = first_section) -> DataFrame:
    """question, answer for each (question, prompt) by any callable."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"question": batch["question"], "answer": [answer(q, p) for q, p in zip(batch["question"], batch["prompt"])]})

    return prompts.select("question", "prompt").mapInPandas(run, "question string, answer string")


Piece = tuple[str, bool]


def answer_chunks(prompts: DataFrame, stream: Callable[[str, str], Iterator[Piece]]) -> DataFrame:
    """question, chunk_no, text, is_thought for each (question, prompt): the
    pieces in which a callable gives an answer, passed on as they come."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, p in zip(batch["question"], batch["prompt"]):
                for k, (text, thought) in enumerate(stream(q, p)):
                    yield pd.DataFrame({"question": [q], "chunk_no": [k], "text": [text], "is_thought": [thought]})

    return prompts.select("question", "prompt").mapInPandas(run, "question string, chunk_no int, text string, is_thought boolean")


def in_pieces(answer: Callable[[str, str], str] = first_section, size: int = 200) -> Callable[[str, str], Iterator[Piece]]:
    """A stream of pieces from a callable that gives whole answers."""
    return lambda q, p: ((a[i : i + size], False) for a in [answer(q, p)] for i in range(0, len(a), size))


def answers_with_thoughts(prompts: DataFrame, stream: Callable[[str, str], Iterator[Piece]], chars_per_token: int = 4) -> DataFrame:
    """question, answer, thoughts and the estimated tokens of prompt, answer and thoughts."""
    chunks = answer_chunks(prompts, stream)
    joined = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("chunk_no", "text")))), lambda x: x["text"]), "")
    parts = chunks.groupBy("question").agg(joined(F.col("is_thought")).alias("thoughts"), joined(~F.col("is_thought")).alias("answer"))
    rows = prompts.select("question", "prompt").join(parts, "question", "left").fillna("", ["thoughts", "answer"])
    tokens = lambda c: estimated_tokens(F.col(c), chars_per_token)
    return rows.select(
        "question", "answer", "thoughts", tokens("prompt").alias("prompt_tokens"), tokens("answer").alias("answer_tokens"), tokens("thoughts").alias("thought_tokens")
    )


def split_parts(parts: DataFrame) -> DataFrame:
    """qid, thoughts, answer from parts (qid, pos, is_thought, text)."""
    joined = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "text")))), lambda x: x["text"]), "")
    return parts.groupBy("qid").agg(joined(F.col("is_thought")).alias("thoughts"), joined(~F.col("is_thought")).alias("answer"))


def history(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and what was said before, oldest first; the plain question is kept, not its prompt."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    said = F.concat_ws(": ", "role", "text")
    before = F.collect_list(said).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return turns.select("conv_id", "turn", "role", "text", F.size(before).alias("n_before"), F.array_join(before, "\n").alias("history"))


def appended(turns: DataFrame, answered: DataFrame) -> DataFrame:
    """turns with each question (conv_id, question, answer) and its answer behind the last one."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    new = answered.join(last, "conv_id", "left").withColumn("last", F.coalesce("last", F.lit(-1)))
    row = lambda k, role, text: new.select("conv_id", (F.col("last") + k).cast("long").alias("turn"), F.lit(role).alias("role"), F.col(text).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(row(1, "user", "question")).unionByName(row(2, "assistant", "answer"))


def conversation(turns: DataFrame, chars_per_token: int = 4) -> DataFrame:
    """conv_id, turns, tokens of what each conversation has said so far."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(estimated_tokens(F.col("text"), chars_per_token)).alias("tokens"))


class ChatSession:
    """A conversation about a corpus: each question gets a context of its own
    and what was said before; the history keeps the plain questions."""

    def __init__(self, contexts: Callable[[str], str], stream: Callable[[str, str], Iterator[Piece]] | None = None, show_thoughts: bool = False):
        self.contexts, self.stream, self.show_thoughts = contexts, stream or in_pieces(), show_thoughts
        self.turns: list[tuple[str, str]] = []

    def _message(self, question: str) -> str:
        before = "\n".join(f"{role}: {text}" for role, text in self.turns)
        own = self.contexts(question)
        return f"{before}\n\n{own}" if before else own

    def ask_stream(self, question: str) -> Iterator[str]:
        answer = []
        for text, thought in self.stream(question, self._message(question)):
            if thought and not self.show_thoughts:
                continue
            answer.append(f"\n({text})\n" if thought else text)
            yield answer[-1]
        self.turns += [("user", question), ("assistant", "".join(answer))]

    def ask(self, question: str) -> str:
        return "".join(self.ask_stream(question))

    def history(self) -> list[dict[str, str]]:
        return [{"role": role, "content": text} for role, text in self.turns]


def utilization(used: Column, budget: int) -> Column:
    return F.round(used * 100.0 / budget, 6)
