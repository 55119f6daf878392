"""Chat formatting of typed content parts.

A turn's content is a list of typed parts: text, image, audio, document. A visitor has one method per type; it flattens a part into
text or an ordered placeholder, with the reference of what is attached and the tokens that the placeholder stands for once a model
expands it. All of that is column functions, map-side.

In the output, marks open and close a turn and part its role from its text. Wherever text holds a mark, or anything else that could
be taken for one, a backslash after the mark's first character breaks it; backslashes themselves are doubled. No mark then occurs in
text, whatever the text is, and the way back is exact.

A conversation's turns are put together as they stream by in order, so a task holds one output row of at most about PART_CHARS
characters (or one turn), however many turns a conversation has: a longer one becomes several rows, cut at ends of turns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.tables import filled, table

PART_CHARS = 1 << 20
CONTENT = "array<struct<type: string, text: string, ref: string, width: bigint, height: bigint, seconds: double, pages: bigint>>"
ATTACHMENT = "struct<place: bigint, kind: string, ref: string, tokens: bigint>"
FORMATTED = ("conv_id bigint, part bigint, start bigint, formatted string, n_turns bigint, loss_spans array<struct<start: bigint, end: bigint>>, "
             f"attachments array<struct<turn: bigint, place: bigint, kind: string, ref: string, tokens: bigint>>, expanded_tokens bigint, last boolean")


@dataclass(frozen=True)
class Template:
    """Marks have two characters or more and no backslash. ``guarded`` are other strings that must not show up in text."""

    open: str = "<turn>"
    text: str = "<text>"
    close: str = "</turn>"
    placeholder: str = "<|"
    placeholder_end: str = "|>"
    guarded: tuple[str, ...] = ("### System:", "### User:", "### Assistant:", "<s>", "</s>")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if any(len(mark) < 2 or "\\" in mark for mark in self.marks()):
            raise ValueError("marks need two characters or more and no backslash")

    def marks(self) -> tuple[str, ...]:
        return (self.open, self.text, self.close, self.placeholder, self.placeholder_end, *self.guarded)


PLAIN = Template()


def escaped(text: Column, template: Template = PLAIN) -> Column:
    """``text`` without any mark: a backslash after every backslash and after the first character of every mark."""
    marks = "|".join(re.sub(r"([^A-Za-z0-9 ])", r"\\\1", mark) for mark in template.marks())
    return F.regexp_replace(text, rf"(?s)\\|(?={marks}).", r"$0\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


@dataclass(frozen=True)
class PartVisitor:
    """Flattens one part: ``rendered`` text, and for attachments their ``kind``, ``ref`` and ``tokens`` (null for text).

    An image takes one token per patch of its size, audio tokens by length, a document by page; what is not known counts as one unit. A
    part of another type keeps its place as an attachment of kind ``other`` with one token.
    """

    template: Template = field(default_factory=Template)
    patch: int = 14
    audio_rate: float = 25.0
    page_tokens: int = 512

    def visit(self, part: Column, place: Column) -> Column:
        kind = F.coalesce(part["type"], F.lit("text"))
        return (F.when(kind == "text", self.text(part)).when(kind == "image", self.image(part, place)).when(kind == "audio", self.audio(part, place))
                .when(kind == "document", self.document(part, place)).otherwise(self.other(part, place)))

    def text(self, part: Column) -> Column:
        nothing = F.lit(None).cast("string")
        return self._flat(escaped(F.coalesce(part["text"], F.lit("")), self.template), nothing, nothing, F.lit(None).cast("bigint"))

    def image(self, part: Column, place: Column) -> Column:
        across, down = (F.greatest(F.lit(1), F.ceil(F.coalesce(part[side], F.lit(1)) / self.patch)) for side in ("width", "height"))
        return self._attached("image", part, place, across * down)

    def audio(self, part: Column, place: Column) -> Column:
        return self._attached("audio", part, place, F.greatest(F.lit(1), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.audio_rate)))

    def document(self, part: Column, place: Column) -> Column:
        return self._attached("document", part, place, F.greatest(F.lit(1), F.coalesce(part["pages"], F.lit(1))) * self.page_tokens)

    def other(self, part: Column, place: Column) -> Column:
        return self._attached("other", part, place, F.lit(1))

    def _attached(self, kind: str, part: Column, place: Column, tokens: Column) -> Column:
        mark = F.concat(F.lit(f"{self.template.placeholder}{kind}_"), place.cast("string"), F.lit(self.template.placeholder_end))
        return self._flat(mark, F.lit(kind), part["ref"], tokens.cast("bigint"))

    @staticmethod
    def _flat(rendered: Column, kind: Column, ref: Column, tokens: Column) -> Column:
        return F.struct(rendered.alias("rendered"), kind.alias("kind"), ref.alias("ref"), tokens.alias("tokens"))


def _content(content: Column, plain: bool) -> Column:
    if not plain:
        return F.coalesce(content.cast(CONTENT), F.array().cast(CONTENT))
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "bigint"), ("height", "bigint"), ("seconds", "double"), ("pages", "bigint"))]
    return F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *blank))


def rendered(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", content: str | None = None,
             visitor: PartVisitor | None = None) -> DataFrame:
    """``conv_id, turn, segment, loss_start, loss_chars, attachments``, one row per turn: its text in the output, where in it the loss applies
    (code points; -1 where it does not) and what is attached. ``content`` names a column of typed parts; else ``text`` is one text part."""
    visitor = visitor or PartVisitor()
    template = visitor.template
    parts = _content(F.col(content) if content else filled(text), plain=content is None)
    flat = F.transform(parts, lambda part, place: visitor.visit(part, place + 1))
    rows = turns.select(
        F.col(conversation).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), filled(role).alias("role"), flat.alias("flat"))
    body = F.array_join(F.transform("flat", lambda f: f["rendered"]), "")
    rows = rows.select("conv_id", "turn", "role", body.alias("body"), F.transform(
        F.filter(F.transform("flat", lambda f, i: F.struct((i + 1).cast("bigint").alias("place"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens"))),
                 lambda f: f["kind"].isNotNull()), lambda f: f.cast(ATTACHMENT)).alias("attachments"))
    head = F.concat(F.lit(template.open), escaped(F.col("role"), template), F.lit(template.text))
    learned = F.col("role").isin(*template.learned)
    return rows.select(
        "conv_id", "turn", F.concat(head, F.col("body"), F.lit(template.close + "\n")).alias("segment"),
        F.when(learned, F.char_length(head)).otherwise(-1).cast("bigint").alias("loss_start"), F.char_length("body").cast("bigint").alias("loss_chars"), "attachments")


def formatted(turns: DataFrame, **columns) -> DataFrame:
    """One row per conversation, or several ``part``s of a long one: ``formatted`` text, ``start`` of the part in the conversation, spans under the loss
    mask (in the part, code points, end exclusive), ``attachments`` with their turn in the conversation, tokens that these expand to, and
    whether the part is the ``last``.

    Turns are ordered by ``turn`` (null first); equal turns by their text in the output. Null roles and texts count as empty, repeated rows are turns
    of their own, and a null conversation is one like any other. Only assistants' texts are under the loss mask. No rows give no
    rows. Only the named columns are read. A conversation's parts follow one another in a partition.
    """

    def assemble(batches: Iterator) -> Iterator:
        import pandas as pd

        names = ["conv_id", "part", "start", "formatted", "n_turns", "loss_spans", "attachments", "expanded_tokens", "last"]
        held: dict = {}

        def opened(conv, part=0, start=0, turn=0):
            return {"conv": conv, "part": part, "start": start, "turn": turn, "first": turn, "text": [], "chars": 0, "spans": [], "attached": []}

        def row(last: bool):
            tokens = sum(a["tokens"] for a in held["attached"])
            return (held["conv"], held["part"], held["start"], "".join(held["text"]), held["turn"] - held["first"], held["spans"], held["attached"], tokens, last)

        def frame(rows):
            return pd.DataFrame(rows, columns=names)

        for batch in batches:
            done = []
            for conv, segment, low, size, attached in zip(batch["conv_id"], batch["segment"], batch["loss_start"], batch["loss_chars"], batch["attachments"]):
                if held and held["conv"] != conv:
                    done.append(row(True))
                    held = {}
                if not held:
                    held = opened(conv)
                if held["chars"] and held["chars"] + len(segment) > PART_CHARS:
                    done.append(row(False))
                    held = opened(conv, held["part"] + 1, held["start"] + held["chars"], held["turn"])
                held["turn"] += 1
                if low >= 0:
                    held["spans"].append({"start": held["chars"] + int(low), "end": held["chars"] + int(low + size)})
                held["attached"] += [{"turn": held["turn"], **{k: a[k] for k in ("place", "kind", "ref", "tokens")}} for a in attached]
                held["text"].append(segment)
                held["chars"] += len(segment)
                if len(done) >= 500:
                    yield frame(done)
                    done = []
            if done:
                yield frame(done)
        if held:
            yield frame([row(True)])

    rows = rendered(turns, **columns)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment").withColumn("conv_id", F.col("conv_id").cast("string"))
    formats = ordered.mapInPandas(assemble, FORMATTED.replace("conv_id bigint", "conv_id string"))  # as text: pandas has no long with nulls
    return formats.withColumn("conv_id", F.col("conv_id").cast("bigint"))


def turns_in(text: str, template: Template = PLAIN) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(role, parts) of each turn in a formatted text; a part is ("text", its text) or (kind, number of its place)."""
    marks = [re.escape(m) for m in (template.open, template.text, template.close)]
    slot = re.compile(f"{re.escape(template.placeholder)}([a-z]+)_([0-9]+){re.escape(template.placeholder_end)}")
    for turn in re.finditer(f"{marks[0]}(.*?){marks[1]}(.*?){marks[2]}\n", text, re.S):
        pieces = slot.split(turn[2])
        parts = [("text", unescaped(pieces[0]))]
        for kind, place, after in zip(pieces[1::3], pieces[2::3], pieces[3::3]):
            parts += [(kind, place), ("text", unescaped(after))]
        yield unescaped(turn[1]), [p for p in parts if p[0] != "text" or p[1]]


def read_back(formats: DataFrame, template: Template = PLAIN) -> DataFrame:
    """Per conversation, from the formatted texts alone: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, expanded_tokens``.

    Digests run over the parts as they stream by. Reads the rows of ``formatted`` in their partitions; rows read from files need
    ``repartition("conv_id").sortWithinPartitions("conv_id", "part")`` first.
    """

    def read(batches: Iterator) -> Iterator:
        import hashlib

        import pandas as pd

        state = None
        for batch in batches:
            rows = []
            for conv, text, spans, tokens, last in zip(batch["conv_id"], batch["formatted"], batch["loss_spans"], batch["expanded_tokens"], batch["last"]):
                if state is None:
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, parts in turns_in(text, template):
                    state[0] += 1
                    body = "".join(said if kind == "text" else f"{template.placeholder}{kind}_{said}{template.placeholder_end}" for kind, said in parts)
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in spans:
                    learned = unescaped(text[span["start"]:span["end"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
                state[5] += int(tokens)
                if last:
                    rows.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))
                    state = None
            if rows:
                yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "expanded_tokens"])

    told = formats.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(
        read, "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, expanded_tokens bigint")
    return told.withColumn("conv_id", F.col("conv_id").cast("bigint"))


GUARD = -7  # a conversation of control strings beside the given ones
GUARD_TEXT = r"\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    guard = spark.range(2).select(
        F.lit(GUARD).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(GUARD_TEXT).alias("text"))
    return read_back(formatted(turns.unionByName(guard)))


_MARKED = "replace(coalesce({0}, ''), '\\', '\\\\')"
for _mark in PLAIN.marks():
    _MARKED = f"replace({_MARKED}, '{_mark}', '{_mark[0]}\\{_mark[1:]}')"

OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
  UNION ALL SELECT {GUARD}, 0, 'user', '{GUARD_TEXT}' UNION ALL SELECT {GUARD}, 1, 'assistant', '{GUARD_TEXT}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(said)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(said, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_MARKED.format("role")}) + length({_MARKED.format("said")}) + {len(PLAIN.open + PLAIN.text + PLAIN.close) + 1}) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS expanded_tokens
FROM turns GROUP BY conv_id
"""
