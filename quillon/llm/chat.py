"""Chat formatting: records of many layouts to canonical turns, and turns to one marked text with a loss mask.

Which layout a record has is told by a fingerprint: a hash of the nested field paths it fills, of
those that any layout mentions. Each layout is a declaration (paths and roles); the fingerprints of
all its forms are constants of the plan. All steps are DataFrame functions.

Nulls: a null field is a path that is not filled; a null text inside a list of turns is empty, a null
role the empty role. Records of no known layout keep their row, with null layout and turns; so do
records that fill two layouts at once. An empty list of turns gives an empty text. Repeated rows give
repeated rows, empty tables none. Columns that an operator adds replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import public

#: The template (fixed values): marks of a turn's begin and end; both begin with the guarded pair.
BEGIN, END = "<|im_start|>", "<|im_end|>"
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Layout:
    """Either a list of turns (``turns``: its column, the fields of role and text) or one field a turn
    (``parts``: role and the fields joined by an empty line). A record has the layout if it fills all
    of ``needed``, any of ``allowed`` and no other path of any layout."""

    name: str
    needed: tuple[str, ...]
    allowed: tuple[str, ...] = ()
    turns: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    #: names of roles in this layout and their canonical ones
    roles: tuple[tuple[str, str], ...] = ()

    def forms(self) -> list[list[str]]:
        return [sorted([*self.needed, *more]) for k in range(len(self.allowed) + 1) for more in combinations(self.allowed, k)]


LAYOUTS = (
    Layout("messages", ("messages",), ("messages[].role", "messages[].content"), turns=("messages", "role", "content")),
    Layout("conversations", ("conversations",), ("conversations[].from", "conversations[].value"), turns=("conversations", "from", "value"),
           roles=(("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))),
    Layout("completion", ("prompt", "completion"), ("system",), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", ("prompt", "response"), ("system",), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question", ("question", "answer"), ("context",), parts=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def record_schema(layouts: tuple[Layout, ...] = LAYOUTS) -> T.StructType:
    """All columns of the layouts, for reading JSON lines or ``from_json``."""
    out = T.StructType()
    for x in layouts:
        if x.turns:
            out = out.add(x.turns[0], T.ArrayType(T.StructType([T.StructField(x.turns[1], T.StringType()), T.StructField(x.turns[2], T.StringType())])))
        else:
            for f in [*x.needed, *x.allowed]:
                out = out if f in out.names else out.add(f, T.StringType())
    return out


def field_paths(kind: T.DataType, name: str) -> list[tuple[str, Callable[[Column], Column]]]:
    """The paths in a column of that type, fields of structs as a.b and of lists as a[].b, each with the
    condition that a value fills it (of a list: that an element does)."""
    out: list[tuple[str, Callable[[Column], Column]]] = [(name, lambda c: c.isNotNull())]
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            out += [(p, partial(_in_struct, f.name, ok)) for p, ok in field_paths(f.dataType, f"{name}.{f.name}")]
    elif isinstance(kind, T.ArrayType):
        inner = field_paths(kind.elementType, f"{name}[]")[1:]
        out += [(p, partial(_in_list, ok)) for p, ok in inner]
    return out


def _in_struct(field: str, ok: Callable[[Column], Column], c: Column) -> Column:
    return ok(c.getField(field))


def _in_list(ok: Callable[[Column], Column], c: Column) -> Column:
    return F.exists(c, lambda x: ok(x))


def _hash(paths: list[str]) -> Column:
    return F.xxhash64(F.lit(",".join(sorted(paths))))


def fingerprint(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the field paths that a row fills, of those that the layouts mention."""
    known = {p for x in layouts for p in [*x.needed, *x.allowed]}
    found = sorted(((p, ok(F.col(f"`{f.name}`"))) for f in df.schema.fields for p, ok in field_paths(f.dataType, f.name) if p in known), key=lambda x: x[0])
    return F.xxhash64(F.concat_ws(",", *[F.when(F.coalesce(ok, F.lit(False)), F.lit(p)) for p, ok in found]))


def _turns(df: DataFrame, x: Layout) -> Column | None:
    """The turns of a row of this layout; None if the table lacks the columns."""
    have = {f.name: f.dataType for f in df.schema.fields}
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if x.turns:
        column, role, body = x.turns
        kind = have.get(column)
        if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
            return None
        names = kind.elementType.names
        field = lambda t, f: text(t.getField(f)) if f in names else F.lit("")

        def one(t: Column) -> Column:
            who = field(t, role)
            for other, canonical in x.roles:
                who = F.when(field(t, role) == other, canonical).otherwise(who)
            return F.struct(who.alias("role"), field(t, body).alias("text"))

        return F.transform(f"`{column}`", one)
    if not set(x.needed) <= set(have):
        return None
    turns = []
    for role, fields in x.parts:
        own = [F.col(f"`{f}`").cast("string") for f in fields if f in have]
        filled = [F.when(c != "", c) for c in own]
        if own:
            turn = F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *filled).alias("text"))
            turns.append(F.when(F.coalesce(*own).isNotNull(), turn))
    return F.filter(F.array(*turns), lambda t: t.isNotNull()).cast(f"array<{TURN}>")


def canonical(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` with fingerprint, layout (a name or null) and turns, an array of (role, text)."""
    known = public(df, "fingerprint", "layout", "turns").withColumn("fingerprint", fingerprint(df, layouts))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    for x in layouts:
        made = _turns(df, x)
        if made is not None:
            fits = F.col("fingerprint").isin(*[_hash(f) for f in x.forms()])
            name, turns = F.when(fits, F.lit(x.name)).otherwise(name), F.when(fits, made).otherwise(turns)
    return known.withColumns({"layout": name, "turns": turns})


def escape(text: Column) -> Column:
    """No ``<|`` is left: a backslash goes between the two, one more where there are some already."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _header(role: Column) -> Column:
    """A role on one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role(header: Column) -> Column:
    return F.array_join(F.transform(F.split(unescape(header), r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def template(df: DataFrame, turns: str = "turns", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``df`` with formatted, the marked text of all turns, and mask, its loss mask: for each turn how many
    characters (code points) to skip and how many then to learn. Only texts of the roles ``learn`` are
    learned, without their marks. Null turns give null for both."""
    tail = len(END) + 1

    def marked(t: Column) -> Column:
        return F.concat(F.lit(BEGIN), _header(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))

    def run(t: Column, k: Column) -> Column:
        head = F.length(_header(t["role"])) + len(BEGIN) + 1 + F.when(k > 0, tail).otherwise(0)
        body, learned = F.length(escape(t["text"])), t["role"].isin(*learn)
        return F.struct((head + F.when(learned, 0).otherwise(body)).cast("int").alias("skip"), F.when(learned, body).otherwise(0).alias("take"))

    whole = F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    out = public(df, "formatted", "mask").withColumn("_whole", whole)
    return out.withColumns({"formatted": F.array_join(F.transform("_whole", marked), ""), "mask": F.transform("_whole", run)}).drop("_whole")


def read_back(df: DataFrame) -> DataFrame:
    """From formatted and mask alone: turns_back, an array of (role, text), and learned, the texts under the
    mask; both unescaped. A text without turns gives empty lists."""
    tail = len(END) + 1
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.greatest(F.lit(1), F.size("mask")))

    def turn(p: Column) -> Column:
        at = F.locate("\n", p)
        return F.struct(_role(p.substr(F.lit(1), at - 1)).alias("role"), unescape(p.substr(at + 1, F.length(p) - at - tail)).alias("text"))

    def under(p: Column, k: Column) -> Column:
        run = F.element_at("mask", k + 1)
        return unescape(p.substr(run["skip"] - F.when(k > 0, tail).otherwise(0) - len(BEGIN) + 1, run["take"]))

    out = public(df, "turns_back", "learned").withColumn("_pieces", pieces)
    return out.withColumns({"turns_back": F.transform("_pieces", turn), "learned": F.transform("_pieces", under)}).drop("_pieces")


def digest(df: DataFrame) -> DataFrame:
    """``df`` without its long columns, with counts and digests of what :func:`read_back` gave."""
    said = F.array_join(F.transform("turns_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    added = {"n_turns": F.size("turns_back").cast("long"), "turns_sha256": F.sha2(said, 256), "loss_chars": F.length(loss).cast("long"), "loss_sha256": F.sha2(loss, 256),
             "formatted_chars": F.length("formatted").cast("long")}
    return df.withColumns(added).drop("formatted", "mask", "turns_back", "learned", "turns")


def records(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one record a conversation, each in the layout that suits it: an
    exchange as prompt and completion, one after a system text as instruction and output, others as a
    list: of from and value if the id is odd and all roles have a name there, else of role and content.

    Rows go by turn, ties by role and text, nulls first; rows without a conv_id are one conversation. A
    conversation is one row in the end, so its texts must fit one task; lists are merged map-side.
    """
    own = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(own)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    is_ = lambda *names: roles == F.array(*map(F.lit, names))
    text = lambda k: F.element_at("t", k)["text"]
    named = F.forall("t", lambda x: x["role"].isin("system", "user", "assistant"))
    kind = F.when(is_("user", "assistant"), "completion").when(is_("system", "user", "assistant"), "instruction").when(named & (F.pmod("conv_id", F.lit(2)) == 1), "conversations").otherwise("messages")
    when = lambda name, x: F.when(F.col("_kind") == name, x)
    other = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    return c.withColumn("_kind", kind).select(
        "conv_id", when("messages", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("messages"),
        when("conversations", F.transform("t", lambda x: F.struct(other(x["role"]).alias("from"), x["text"].alias("value")))).alias("conversations"),
        when("completion", text(1)).alias("prompt"), when("completion", text(2)).alias("completion"),
        when("instruction", text(1)).alias("system"), when("instruction", text(2)).alias("instruction"), when("instruction", text(3)).alias("output"),
    )
