"""Chat formatting: fingerprints of field paths pick a declared layout, layouts give turns.

A record is a VARIANT of any nesting. The set of its field paths (``$.messages[].role``),
cut to the paths that some declared layout names, is hashed; the hash looks up the layout,
and the layout says, as data, which paths hold which turns. Turns of a conversation, from one
record or from many, become one text with marked turns and a loss mask, from which everything
can be read back. All of it is built-in column functions.

Defined results: a null text or role is empty; fields that no layout names are ignored; a
record whose fingerprint is not declared, a null record and an empty list give no turns, and
a conversation without turns is the empty text. Turns of equal number stay in the order
(number, place in the record, role, text); repeated rows stay repeated. A record without a
conversation id is a conversation of its own. A record may hold up to 128 MB, the limit of
VARIANT values.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- field paths ---------------------------------------------------------------

#: What the schema text of a VARIANT consists of, besides the names of scalar types.
_SCHEMA_TOKENS = r"OBJECT<>|OBJECT<|ARRAY<|>|, |(?:`(?:[^`]|``)*`|\w+)(?=: )"


def field_paths(record: Column) -> Column:
    """Sorted distinct paths of all fields and array elements of a VARIANT; empty for scalars and null."""
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(_SCHEMA_TOKENS), F.lit(0))
    start = F.struct(F.array(F.lit("$")).alias("open"), F.array().cast("array<string>").alias("paths"))

    def step(at: Column, token: Column) -> Column:
        inner = F.concat(F.element_at(at["open"], -1), F.when(token == "ARRAY<", "[]").otherwise(F.concat(F.lit("."), token)))
        closed = F.struct(F.slice(at["open"], F.lit(1), F.size(at["open"]) - 1).alias("open"), at["paths"].alias("paths"))
        opened = F.struct(F.array_append(at["open"], inner).alias("open"), F.array_append(at["paths"], inner).alias("paths"))
        return F.when(token.isin(">", ", "), closed).when(token.isin("OBJECT<", "OBJECT<>"), at).otherwise(opened)

    return F.coalesce(F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda at: at["paths"]))), F.array().cast("array<string>"))


def fingerprint(paths: Column) -> Column:
    """Hash of a sorted list of paths."""
    return F.xxhash64(F.array_join(paths, "\n"))


# --- layouts -------------------------------------------------------------------


@dataclass(frozen=True)
class Said:
    """One turn of a fixed role; the texts at several paths are joined by a blank line."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Listed:
    """A turn per object of an array."""

    path: str
    role: str
    text: str
    parts: str | None = None  # the field of each part when ``text`` is an array of objects


@dataclass(frozen=True)
class Alternating:
    """A turn per string of an array, the roles in rotation."""

    path: str
    roles: tuple[str, ...] = ("user", "assistant")


@dataclass(frozen=True)
class Row:
    """The whole record is one turn of a conversation."""

    turn: str
    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    """Field paths that make out a layout, and where its turns are."""

    name: str
    required: tuple[str, ...]
    turns: tuple[Said | Listed | Alternating | Row, ...]
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def path_sets(self) -> list[tuple[str, ...]]:
        """Every set of named paths a record of this layout can have, ancestors included."""
        chosen = [c for n in range(len(self.optional) + 1) for c in itertools.combinations(self.optional, n)]
        return [_closed([*self.required, *c]) for c in chosen]

    def empty_sets(self) -> list[tuple[str, ...]]:
        """Path sets of records whose list is empty and so has no fields; several layouts may share one."""
        return [_closed([t.path + "[]"]) for t in self.turns if isinstance(t, Listed)]


def _closed(paths) -> tuple[str, ...]:
    """Paths with all their ancestors, sorted."""
    out = set()
    for path in paths:
        while path != "$":
            out.add(path)
            path = path.removesuffix("[]") if path.endswith("[]") else path[: path.rindex(".")]
    return tuple(sorted(out))


#: Layouts of public conversation and instruction sets.
LAYOUTS = (
    Layout("turn rows", ("$.role", "$.text", "$.turn"), (Row("$.turn", "$.role", "$.text"),)),
    Layout("messages", ("$.messages[].content", "$.messages[].role"), (Listed("$.messages", "role", "content"),)),
    Layout(
        "messages of parts", ("$.messages[].content[].text", "$.messages[].role"),
        (Listed("$.messages", "role", "content", "text"),), ("$.messages[].content[].type",),
    ),
    Layout(
        "from and value", ("$.conversations[].from", "$.conversations[].value"),
        (Said("system", ("$.system",)), Listed("$.conversations", "from", "value")), ("$.system",),
        {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"},
    ),
    Layout(
        "instruction", ("$.instruction", "$.output"),
        (Said("system", ("$.system",)), Said("user", ("$.instruction", "$.input")), Said("assistant", ("$.output",))), ("$.input", "$.system"),
    ),
    Layout("prompt and completion", ("$.prompt", "$.completion"), (Said("user", ("$.prompt",)), Said("assistant", ("$.completion",)))),
    Layout(
        "prompt and response", ("$.prompt", "$.response"),
        (Said("system", ("$.system",)), Said("user", ("$.prompt",)), Said("assistant", ("$.response",))), ("$.system",),
    ),
    Layout(
        "question and answer", ("$.question", "$.answer"),
        (Said("user", ("$.context", "$.question")), Said("assistant", ("$.answer",))), ("$.context",),
    ),
    Layout("dialog", ("$.dialog[]",), (Alternating("$.dialog"),)),
)

_TURNS = "array<struct<turn: bigint, place: int, role: string, text: string>>"


def _registry(layouts: tuple[Layout, ...]) -> dict[tuple[str, ...], int]:
    out: dict[tuple[str, ...], int] = {}
    for number, layout in enumerate(layouts):
        for paths in layout.path_sets():
            if out.setdefault(paths, number) != number:
                raise ValueError(f"layouts {layouts[out[paths]].name!r} and {layout.name!r} share the paths {paths}")
    for number, layout in enumerate(layouts):
        for paths in layout.empty_sets():
            out.setdefault(paths, number)
    return out


def layout_number(paths: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[Column, Column]:
    """(number of the layout, null if none; fingerprint) of records with these field paths."""
    registry = _registry(layouts)
    named = F.array(*[F.lit(p) for p in sorted({p for ps in registry for p in ps})])
    key = fingerprint(F.array_sort(F.array_intersect(paths, named)))
    known = itertools.chain.from_iterable((F.xxhash64(F.lit("\n".join(ps))), F.lit(n)) for ps, n in registry.items())
    return F.try_element_at(F.create_map(*known), key), key


def _text(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "string")


def _renamed(role: Column, roles: dict[str, str]) -> Column:
    if not roles:
        return role
    table = F.create_map(*itertools.chain.from_iterable((F.lit(a), F.lit(b)) for a, b in roles.items()))
    return F.coalesce(F.try_element_at(table, role), role)


def _turn(turn: Column, role: Column, text: Column) -> Column:
    empty = F.lit("")
    return F.struct(turn.alias("turn"), F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("text"))


def _spoken(part, record: Column, paths: Column, roles: dict[str, str]) -> Column:
    """array<struct<turn, role, text>> of one part of a layout."""
    none = F.lit(None).cast("long")
    if isinstance(part, Row):
        return F.array(_turn(F.try_variant_get(record, part.turn, "bigint"), _renamed(_text(record, part.role), roles), _text(record, part.text)))
    if isinstance(part, Said):
        texts = F.filter(F.array(*[_text(record, p) for p in part.paths]), lambda t: t.isNotNull() & (t != ""))
        there = F.arrays_overlap(paths, F.array(*[F.lit(p) for p in part.paths]))
        return F.when(there, F.array(_turn(none, F.lit(part.role), F.array_join(texts, "\n\n"))))
    if isinstance(part, Alternating):
        names = F.array(*[F.lit(r) for r in part.roles])
        said = F.try_variant_get(record, part.path, "array<string>")
        return F.transform(said, lambda t, i: _turn(none, F.element_at(names, (i % len(part.roles) + 1).cast("int")), t))
    kind = "string" if part.parts is None else f"array<struct<`{part.parts}`: string>>"
    said = F.try_variant_get(record, part.path, f"array<struct<`{part.role}`: string, `{part.text}`: {kind}>>")

    def one(m: Column) -> Column:
        text = m[part.text]
        if part.parts is not None:
            text = F.array_join(F.transform(text, lambda p: F.coalesce(p[part.parts], F.lit(""))), "")
        return _turn(none, _renamed(m[part.role], roles), text)

    return F.transform(said, one)


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """(conv_id, layout, fingerprint, turns array<turn, place, role, text>) per record; layout null and no turns if undeclared."""
    paths = records.select(F.col(id_col).alias("conv_id"), F.col(record_col).alias("record"), field_paths(F.col(record_col)).alias("paths"))
    number, key = layout_number(F.col("paths"), layouts)
    chosen = paths.withColumn("number", number).withColumn("fingerprint", key)
    empty = F.array().cast("array<struct<turn: bigint, role: string, text: string>>")
    turns, names = empty, F.array(*[F.lit(x.name) for x in layouts])
    for n, layout in enumerate(layouts):
        said = [F.coalesce(_spoken(p, F.col("record"), F.col("paths"), layout.roles), empty) for p in layout.turns]
        turns = F.when(F.col("number") == n, F.concat(*said)).otherwise(turns)
    numbered = F.transform(turns, lambda t, i: F.struct(t["turn"].alias("turn"), i.alias("place"), t["role"].alias("role"), t["text"].alias("text")))
    return chosen.select("conv_id", F.get(names, F.col("number")).alias("layout"), "fingerprint", numbered.cast(_TURNS).alias("turns"))


# --- template ------------------------------------------------------------------

# The template. A role is URL-encoded, so a heading ends at its first colon.
TURN_START, HEADING_END, TURN_END = "### ", ":\n", "\n</turn>\n"
#: Control strings that texts may hold.
CONTROL = r"(###|</turn>)"


def escape(text: Column) -> Column:
    """One more backslash before every control string and the backslashes in front of it."""
    return F.regexp_replace(text, r"(?<!\\)(\\*+)" + CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\(\\*+)" + CONTROL, "$1$2")


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss array<struct<start, length>> per conversation, from ``canonical_turns``.

    Places are code points of ``formatted``, from 0. Running lengths come from a window over
    the conversation, which shares its one shuffle with the aggregation.
    """
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = turns.select("conv_id", own.alias("own"), F.explode_outer("turns").alias("t"))
    heading = F.concat(F.lit(TURN_START), F.url_encode("t.role"), F.lit(HEADING_END))
    parts = rows.select(
        "conv_id", "own", "t", F.length(heading).alias("n_heading"),
        F.when(F.col("t").isNotNull(), F.concat(heading, escape(F.col("t.text")), F.lit(TURN_END))).alias("segment"),
    )
    order = Window.partitionBy("conv_id", "own").orderBy("t.turn", "t.place", "t.role", "t.text").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.select(
        "conv_id", "own", F.count(F.lit(1)).over(order).alias("n"), "segment", (F.col("t.role") == loss_role).alias("learnt"),
        (F.sum(F.length("segment")).over(order) - F.length("segment") + F.col("n_heading")).alias("start"),
        (F.length("segment") - F.col("n_heading") - len(TURN_END)).cast("long").alias("length"),
    )
    whole = placed.groupBy("conv_id", "own").agg(F.array_sort(F.collect_list(F.struct("n", "segment", "learnt", "start", "length"))).alias("s"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("formatted"),
        F.transform(F.filter("s", lambda x: x["learnt"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.split(formatted, TURN_END)  # the last one is empty
    role = lambda s: F.url_decode(F.substr(F.substring_index(s, ":", 1), F.lit(len(TURN_START) + 1)))
    text = lambda s: unescape(F.substr(s, F.instr(s, HEADING_END) + len(HEADING_END)))
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda s: F.struct(role(s).alias("role"), text(s).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(chats: DataFrame) -> DataFrame:
    """Numbers and digests of formatted conversations, all read back from text and mask."""
    read = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learnt"))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spelled, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_chats(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """Formatted conversations of heterogeneous records: conv_id, formatted, loss."""
    return format_turns(canonical_turns(records, layouts, id_col, record_col))


def undeclared(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """Fingerprints without a layout: how many records have them, and all field paths of one of these."""
    number, key = layout_number(F.col("paths"), layouts)
    paths = records.select(field_paths(F.col(record_col)).alias("paths"))
    return paths.where(number.isNull()).groupBy(key.alias("fingerprint")).agg(F.count(F.lit(1)).alias("n_records"), F.min("paths").alias("paths"))


def row_records(table: DataFrame) -> DataFrame:
    """(conv_id, record) of a table with one turn per row (conv_id, turn, role, text)."""
    return table.select(F.col("conv_id").cast("long").alias("conv_id"), F.to_variant_object(F.struct("turn", "role", "text")).alias("record"))


def message_record(table: DataFrame, conv_id: int, messages: list[tuple[str, str]]) -> DataFrame:
    """(conv_id, record) of one conversation given as a list of messages, next to ``table``."""
    said = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("content")) for r, t in messages])
    return table.sparkSession.range(1).select(F.lit(conv_id).cast("long").alias("conv_id"), F.to_variant_object(F.struct(said.alias("messages"))).alias("record"))
