"""Chat formatting: records of many layouts become marked turns, chosen by the fingerprint of their fields."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo.llm.common import quoted, unpacked
from arqueo.schema import ContractError

# --- Fixed values: the marks of the template ---
START, END = "<|im_start|>", "<|im_end|>"
LINE_FEED = "<|lf|>"  # a line feed inside a role
# --- end of fixed values ---
TAIL = END + "\n"
TURN = "array<struct<role:string,text:string>>"
MASK = "array<struct<skip:int,keep:int,rest:int>>"


@dataclass(frozen=True)
class Field:
    """One turn from fields of the record; several fields are joined by an empty line. No field, no turn."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Listed:
    """One turn for every element of a list of records; ``text`` may go on into a list of parts (``content[].text``)."""

    path: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class TurnRow:
    """The record is one turn; the rows of a key are its conversation, in the order of ``order``."""

    order: str
    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    """What a record looks like and how it becomes turns.

    A record has this layout if its nested field paths are the ``required`` ones and any of the
    ``optional`` ones, and no others.
    """

    name: str
    turns: tuple[Field | Listed | TurnRow, ...]
    required: frozenset[str]
    optional: frozenset[str] = frozenset()

    def path_sets(self) -> list[frozenset[str]]:
        extra = sorted(self.optional)
        return [self.required | set(c) for n in range(len(extra) + 1) for c in combinations(extra, n)]

    @property
    def by_rows(self) -> bool:
        return isinstance(self.turns[0], TurnRow)


def fields(name: str, *turns: Field, optional: Collection[str] = ()) -> Layout:
    named = {p for t in turns for p in t.paths}
    return Layout(name, turns, frozenset(named - set(optional)), frozenset(optional))


def listed(name: str, each: Listed, *first: Field) -> Layout:
    """A list of messages; the list itself is required, what its elements hold is optional."""
    inner = [f"{each.path}[]", f"{each.path}[].{each.role}"]
    steps = each.text.split("[]")
    inner += [f"{each.path}[]." + "[]".join(steps[:i + 1]) for i in range(len(steps))]
    inner += [f"{each.path}[]." + "[]".join(steps[:i]) + "[]" for i in range(1, len(steps))]
    return Layout(name, (*first, each), frozenset([each.path]), frozenset(inner) | {p for f in first for p in f.paths})


SHARED_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
LAYOUTS = (
    Layout("turn rows", (TurnRow("turn", "role", "text"),), frozenset(), frozenset({"turn", "role", "text"})),
    listed("messages", Listed("messages", "role", "content"), Field("system", ("system",))),
    listed("message parts", Listed("messages", "role", "content[].text"), Field("system", ("system",))),
    listed("shared conversations", Listed("conversations", "from", "value", SHARED_ROLES), Field("system", ("system",))),
    fields(
        "instruction", Field("system", ("system",)), Field("user", ("instruction", "input")), Field("assistant", ("output",)),
        optional=("system", "input"),
    ),
    fields("prompt and completion", Field("system", ("system",)), Field("user", ("prompt",)), Field("assistant", ("completion",)), optional=("system",)),
    fields("prompt and response", Field("system", ("system",)), Field("user", ("prompt",)), Field("assistant", ("response",)), optional=("system",)),
    fields("question and answer", Field("user", ("context", "question")), Field("assistant", ("answer",)), optional=("context",)),
)


def _named(path: str, name: str) -> str:
    """Names with other characters than letters, digits and _ are quoted, so that paths stay distinct."""
    safe = name if re.fullmatch(r"\w+", name) else "`" + name.replace("`", "``") + "`"
    return f"{path}.{safe}" if path else safe


def _of_field(name: str, has: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda v: has(v.getField(name))


def _of_any(has: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda v: F.coalesce(F.exists(v, has), F.lit(False))


def _inside(kind: T.DataType, path: str) -> list[tuple[str, Callable[[Column], Column]]]:
    """The nested field paths of a value, each with the test whether a value has it."""
    found = [(path, lambda v: v.isNotNull())] if path else []
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            found += [(p, _of_field(f.name, has)) for p, has in _inside(f.dataType, _named(path, f.name))]
    elif isinstance(kind, T.ArrayType):
        found += [(p, _of_any(has)) for p, has in _inside(kind.elementType, f"{path}[]")]
    return found


def fingerprint(paths: Collection[str]) -> Column:
    """The fingerprint of a set of paths, as a constant."""
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def schema_fingerprint(value: Column, kind: T.StructType) -> Column:
    """64-bit hash of the sorted nested field paths a record holds: null fields are not there, lists of any length are one path."""
    found = sorted(_inside(kind, ""))
    there = [F.when(has(value), F.lit(path)) for path, has in found]
    return F.xxhash64(F.array_join(F.array(*there), "\n")) if there else fingerprint([])


def _value(record: Column, path: str) -> Column:
    return reduce(lambda v, name: v.getField(name), path.split("."), record)


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _part_turns(part: Field | Listed, record: Column, known: set[str]) -> Column:
    """The turns of one part of a layout, as an array."""
    none = F.array().cast(TURN)
    if isinstance(part, Field):
        there = [_value(record, p).cast("string") for p in part.paths if p in known]
        if not there:
            return none
        turn = F.struct(F.lit(part.role).alias("role"), F.concat_ws("\n\n", *there).alias("text"))
        return F.when(F.coalesce(*there).isNotNull(), F.array(turn)).otherwise(none)
    roles = F.create_map(*[F.lit(x) for pair in part.roles for x in pair]) if part.roles else None

    def role_of(message: Column) -> Column:
        role = _text(message.getField(part.role)) if f"{part.path}[].{part.role}" in known else F.lit("")
        return role if roles is None else F.coalesce(F.try_element_at(roles, role), role)

    def text_of(message: Column) -> Column:
        if f"{part.path}[].{part.text}" not in known:
            return F.lit("")
        if "[]." not in part.text:
            return _text(message.getField(part.text))
        outer, inner = part.text.split("[].")
        return _text(F.array_join(F.transform(message.getField(outer), lambda p: p.getField(inner).cast("string")), "\n"))

    listing = F.transform(_value(record, part.path), lambda m: F.struct(role_of(m).alias("role"), text_of(m).alias("text")))
    return F.coalesce(listing.cast(TURN), none)


def escaped(text: Column) -> Column:
    r"""No ``<|`` is left: a backslash more stands between ``<`` and ``|``. ``unescaped`` takes it out again."""
    return F.when(text.contains("<"), F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")).otherwise(text)


def unescaped(text: Column) -> Column:
    return F.when(text.contains("<\\"), F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")).otherwise(text)


def known_layouts(record: T.StructType, layouts: Sequence[Layout]) -> list[Layout]:
    """The layouts whose required fields a frame can hold at all; turn rows need a role or a text field."""
    known = {p for p, _ in _inside(record, "")}
    return [m for m in layouts if m.required <= known and (m.required or m.optional & known - {getattr(m.turns[0], "order", "")})]


def layouts_found(records: DataFrame, ignore: Collection[str] = (), layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(fingerprint, layout, paths, records): what the records look like; layout is null where none is declared.

    For exploring new sources: ``paths`` is what a new ``Layout`` has to name.
    """
    kind, cells = _record(records, ignore)
    record = F.struct(*cells)
    seen = records.select(
        schema_fingerprint(record, kind).alias("fingerprint"),
        F.array_compact(F.array(*[F.when(has(record), F.lit(p)) for p, has in sorted(_inside(kind, ""))])).alias("paths"),
    )
    counted = seen.groupBy("fingerprint").agg(F.first("paths").alias("paths"), F.count(F.lit(1)).alias("records"))
    return counted.select("fingerprint", _layout_name(known_layouts(kind, layouts)).alias("layout"), "paths", "records")


def _record(records: DataFrame, ignore: Collection[str]) -> tuple[T.StructType, list[Column]]:
    kept = [f for f in records.schema.fields if f.name not in set(ignore)]
    return T.StructType(kept), [quoted(f.name).alias(f.name) for f in kept]


def _layout_name(layouts: Sequence[Layout]) -> Column:
    """The layout of a fingerprint; of two that share a path set the first counts."""
    name, taken = F.lit(None).cast("string"), set()
    for m in layouts:
        fresh = [s for s in m.path_sets() if s not in taken]
        taken |= set(fresh)
        if fresh:
            name = F.coalesce(name, F.when(F.col("fingerprint").isin(*[fingerprint(s) for s in fresh]), F.lit(m.name)))
    return name


def format_chats(records: DataFrame, key: str, ignore: Collection[str] = (), layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Conversations as marked text: (key, layout, fingerprints, formatted, loss_mask).

    Every record is hashed by the nested field paths it holds; the hash selects a declared
    layout, which says how the record's fields become turns of (role, text). ``ignore`` names
    columns that do not belong to the record. Records of all layouts may stand in one frame.

    A turn is ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed. Marks
    inside roles and texts are escaped reversibly. ``loss_mask`` has one entry a turn, in order:
    that many code points without loss, then with loss (the text of an assistant), then without.

    Records of the row layout are grouped by ``key`` and sorted by turn, role and text (nulls
    first); a null key is a conversation of its own, and repeated rows are repeated turns. A
    conversation is one value, so it must fit in a task. Records of the other layouts are
    formatted where they are, each row by itself, also if keys repeat. A null role or text is
    empty; a conversation without turns is the empty text. Records that no layout fits come back
    with a null layout and null text, none is dropped. An empty table gives an empty table.
    """
    kind, cells = _record(records, [key, *ignore])
    chosen, known = known_layouts(kind, layouts), {p for p, _ in _inside(kind, "")}
    judged = records.select(quoted(key).alias("key"), F.struct(*cells).alias("record") if cells else F.struct(F.lit(1).alias("none")).alias("record"))
    judged = judged.withColumn("fingerprint", schema_fingerprint(F.col("record"), kind))
    judged = judged.withColumn("layout", _layout_name(chosen))
    rowwise, whole = [m for m in chosen if m.by_rows], [m for m in chosen if not m.by_rows]
    parts = []
    if rowwise:
        if len(rowwise) > 1:
            raise ContractError("one layout of single turns at most fits a frame")
        parts.append(_by_rows(judged.filter(F.col("layout") == rowwise[0].name), rowwise[0], known))
    turns = F.lit(None).cast(TURN)
    for m in whole:
        own = F.concat(*[_part_turns(p, F.col("record"), known) for p in m.turns])
        turns = F.when(F.col("layout") == m.name, own).otherwise(turns)
    names = [m.name for m in rowwise]
    rest = judged.filter(F.col("layout").isNull() | ~F.col("layout").isin(*names)) if names else judged
    parts.append(rest.select("key", "layout", F.array("fingerprint").alias("fingerprints"), turns.alias("turns")))
    return _marked(reduce(DataFrame.unionByName, parts)).withColumnRenamed("key", key)


def _by_rows(judged: DataFrame, layout: Layout, known: set[str]) -> DataFrame:
    row = layout.turns[0]
    order = F.col("record").getField(row.order) if row.order in known else F.lit(None).cast("int")
    role, text = (_text(F.col("record").getField(c)) if c in known else F.lit("") for c in (row.role, row.text))
    turns = judged.select("key", "layout", "fingerprint", F.struct(order.alias("nth"), role.alias("role"), text.alias("text")).alias("turn"))
    grouped = turns.groupBy("key").agg(
        F.first("layout").alias("layout"), F.array_sort(F.collect_set("fingerprint")).alias("fingerprints"),
        F.sort_array(F.collect_list("turn")).alias("turns"),
    )
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return grouped.select("key", "layout", "fingerprints", plain.cast(TURN).alias("turns"))


def _marked(conversations: DataFrame) -> DataFrame:
    cut = conversations.select("key", "layout", "fingerprints", F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit(LINE_FEED)), F.lit("\n")).alias("head"),
        escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss"),
    )).alias("cut"))
    head, body = (lambda s, n=n: F.char_length(s[n]) for n in ("head", "body"))
    mask = F.transform("cut", lambda s: F.struct(
        F.when(s["loss"], head(s)).otherwise(head(s) + body(s)).alias("skip"),
        F.when(s["loss"], body(s)).otherwise(0).alias("keep"), F.lit(len(TAIL)).alias("rest"),
    ))
    text = F.array_join(F.transform("cut", lambda s: F.concat(s["head"], s["body"], F.lit(TAIL))), "")
    return cut.select("key", "layout", "fingerprints", text.alias("formatted"), mask.cast(MASK).alias("loss_mask"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """The input, with ``turns`` parsed back from ``formatted`` and ``loss_texts`` cut out by ``loss_mask``; both unescaped.

    Null text gives nulls.
    """
    pieces = F.split("formatted", re.escape(START).replace("<", r"\x3C"), -1)
    apart = formatted.select(F.struct(*[quoted(c) for c in formatted.columns]).alias("row"), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("pieces"))
    head = lambda p: F.substring_index(p, "\n", 1)
    turns = F.transform("pieces", lambda p: F.struct(
        unescaped(F.replace(head(p), F.lit(LINE_FEED), F.lit("\n"))).alias("role"),
        unescaped(p.substr(F.char_length(head(p)) + 2, F.char_length(p) - F.char_length(head(p)) - 1 - len(TAIL))).alias("text"),
    ))
    # a piece lacks its start mark, which the mask counts
    losses = F.zip_with("pieces", F.col("row").getField("loss_mask"), lambda p, m: F.when(
        m["keep"] > 0, unescaped(p.substr(m["skip"] - len(START) + 1, m["keep"])),
    ).otherwise(F.lit("")))
    return unpacked(apart.select("row", turns.alias("turns"), losses.alias("losses")), turns=F.col("turns"), loss_texts=F.col("losses"))
