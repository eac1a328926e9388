"""Conversations as training text by a template, with DataFrame functions only.

A block of the template is `<turn>role`, a line feed, the texts of adjacent turns of that role with `<part>` on a line of
its own between them, a line feed, `</turn>` and a line feed. In texts a backslash goes before every backslash and
before the template's three control strings; as each of these begins with the only `<` it has, they never overlap, and
none stands in an escaped text without a backslash before it. A role stands on one line, its % and line feeds written
as %25 and %0A. So the formatted text gives back every turn (`turns`).

`loss_spans` has an array for each block: the start (in code points from the block's first) and length of each text that
bears loss, none in a block of another role (`loss_text` reads them).

A conversation is one row of the result, so Spark's limit of 2 GB a string holds for it. Conversations of more than
`TURNS` rows are sorted and merged in parts of so many turns first, so that no task sorts a long one as a whole; what
remains for one task is to join the parts.

Defined results: null texts and roles are empty ones; a null conv_id is a conversation; turns come by number (null
first), then role, then text; rows that repeat another are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.tables import counted, sent

OPEN, PART, CLOSE = "<turn>", "<part>", "</turn>"
_BETWEEN, _END = f"\n{PART}\n", f"\n{CLOSE}\n"
#: Roles whose texts bear loss.
TRAINED = ("assistant",)
#: Rows of a conversation that are sorted at once.
TURNS = 1024
_BLOCK = "struct<role:string,texts:array<string>>"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (OPEN, PART, CLOSE):
        out = F.replace(out, F.lit(control), F.lit("\\" + control))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\<])", "$1")


def _role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def merged(turns: Column) -> Column:
    """Blocks (role, texts) of sorted turns (role, text): a turn joins the last block where that has its role."""
    single = lambda t: F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))

    def add(blocks: Column, t: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        before = F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0)))
        return F.when(last["role"] == t["role"], F.concat(before, F.array(longer))).otherwise(F.concat(blocks, F.array(single(t))))

    return F.aggregate(turns, F.array().cast(f"array<{_BLOCK}>"), add)


def joined(blocks: Column) -> Column:
    """Blocks with adjacent ones of one role merged, in time linear in their number: for the parts of long conversations."""
    at = F.sequence(F.lit(0), F.size(blocks) - 1)
    starts = F.filter(at, lambda i: (i == 0) | (F.get(blocks, i)["role"] != F.get(blocks, i - 1)["role"]))

    def run(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(blocks))
        texts = F.flatten(F.transform(F.slice(blocks, start + 1, end - start), lambda b: b["texts"]))
        return F.struct(F.get(blocks, start)["role"].alias("role"), texts.alias("texts"))

    return F.transform(starts, run)


def _text(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: F.concat(F.lit(OPEN), b["role"], F.lit("\n"), F.array_join(b["texts"], _BETWEEN), F.lit(_END))), "")


def _spans(blocks: Column, trained: tuple[str, ...]) -> Column:
    kind = "array<struct<start:int,length:int>>"

    def spans(b: Column) -> Column:
        first = F.length(b["role"]) + len(OPEN) + 1
        begun = F.struct(first.alias("at"), F.array().cast(kind).alias("spans"))

        def add(held: Column, text: Column) -> Column:
            own = F.struct(held["at"].alias("start"), F.length(text).alias("length"))
            return F.struct((held["at"] + F.length(text) + len(_BETWEEN)).alias("at"), F.concat(held["spans"], F.array(own)).alias("spans"))

        own = F.aggregate(b["texts"], begun, add, lambda held: held["spans"])
        return F.when(_role_back(b["role"]).isin(*trained), own).otherwise(F.array().cast(kind))

    return F.transform(blocks, spans)


def formatted(rows: DataFrame, trained: tuple[str, ...] = TRAINED, turns: int = TURNS) -> DataFrame:
    """conv_id, formatted, loss_spans of each conversation of rows (conv_id, turn, role, text)."""
    empty = F.lit("")
    said = rows.select(
        "conv_id", F.struct("turn", _role(F.coalesce("role", empty)).alias("role"), escaped(F.coalesce("text", empty)).alias("text")).alias("t")
    )
    blocks = merged(F.sort_array(F.collect_list("t"))).alias("blocks")
    long, n = counted(rows.groupBy(F.col("conv_id").alias("long_id")).agg(F.count("*").alias("n")).where(F.col("n") > turns).select("long_id"), "long-conversations")
    if n["n"]:
        same = said["conv_id"].eqNullSafe(long["long_id"])
        part = F.floor(F.col("t.turn") / turns).alias("part")
        parts = said.join(sent(long, n["n"]), same, "left_semi").groupBy("conv_id", part).agg(blocks)
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("part", "blocks"))), lambda p: p["blocks"])
        whole = parts.groupBy("conv_id").agg(F.flatten(ordered).alias("blocks")).select("conv_id", joined(F.col("blocks")).alias("blocks"))
        short = said.join(sent(long, n["n"]), same, "left_anti").groupBy("conv_id").agg(blocks)
        all_blocks = short.unionByName(whole)
    else:
        all_blocks = said.groupBy("conv_id").agg(blocks)
    return all_blocks.select("conv_id", _text(F.col("blocks")).alias("formatted"), _spans(F.col("blocks"), trained).alias("loss_spans"))


def _read(formatted: Column) -> Column:
    """The blocks of a formatted text, each without its end."""
    every = F.split(formatted, _END)
    return F.slice(every, F.lit(1), F.size(every) - 1)


def turns(formatted: Column) -> Column:
    """array<struct<role, text>> of all turns that a formatted text holds."""

    def read(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        texts = F.split(F.substr(block, F.length(role) + 2), _BETWEEN)
        name = _role_back(F.substr(role, F.lit(len(OPEN) + 1)))
        return F.transform(texts, lambda x: F.struct(name.alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(_read(formatted), read))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, as it was before it was escaped, nothing between."""
    cut = lambda block, own: F.array_join(F.transform(own, lambda s: unescaped(F.substr(block, s["start"] + 1, s["length"]))), "")
    return F.array_join(F.zip_with(_read(formatted), spans, cut), "")


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from chats (see formatted)."""
    read = chats.select("conv_id", "formatted", turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
