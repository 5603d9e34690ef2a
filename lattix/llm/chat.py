"""Chat formatting by relational means only: collect, sort, merge and concatenate turns as Spark expressions.

``format_conversations`` yields one row per conversation:

* ``formatted`` is the training text.  Adjacent turns of one role share a block
  ``<|im_start|>role\\n ... <|im_end|>\\n``; the turns inside a block are parted by ``<|im_sep|>``.
* ``segments`` is the same text cut into pieces, each with its loss flag: joined, they give ``formatted``,
  and the pieces flagged ``loss`` are the assistant texts.

Control strings inside a text are escaped reversibly: ``<``, n backslashes and ``|`` get one backslash more, so
``<|`` stands for a control string and nothing else.  Roles are URL-encoded, which leaves plain names as they are.

Defined results: a null text, role or turn counts as an empty text, an empty role and as the first turn; equal
turn numbers are ordered by role, then text; repeated rows stay repeated turns; rows with a null ``conv_id`` form one
conversation with a null id; an empty table gives no rows; further columns are ignored.  A conversation is one row of
the result, so its turns meet in one task by definition; the work there is linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_conversations(turns: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) rows to (conv_id, formatted, segments array<struct<text, loss>>)."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", "t", F.size("t").alias("n"))

    def opens(i: Column) -> Column:
        return (i == 0) | (F.col("t")[F.greatest(i - 1, F.lit(0))]["role"] != F.col("t")[i]["role"])

    starts = F.filter(F.sequence(F.lit(0), F.col("n") - 1), opens)
    got = got.withColumn("starts", starts).withColumn("n_blocks", F.size("starts"))

    def block(start: Column, k: Column) -> Column:
        after = F.when(k + 1 < F.col("n_blocks"), F.col("starts")[k + 1]).otherwise(F.col("n"))
        return F.slice(F.col("t"), start + 1, after - start)

    got = got.select("conv_id", F.transform("starts", block).alias("blocks"))

    def piece(text: Column, loss) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def merged(b: Column) -> Column:
        """The pieces of a block: its head, its texts with separators between them, its end."""
        head = F.concat(F.lit(START), F.url_encode(b[0]["role"]), F.lit("\n"))
        loss = b[0]["role"] == loss_role
        body = F.flatten(
            F.transform(
                b,
                lambda x, j: F.array(
                    piece(F.when(j > 0, F.lit(SEP)).otherwise(F.lit("")), False),
                    F.struct(escape(x["text"]).alias("text"), loss.alias("loss")),
                ),
            )
        )
        return F.concat(F.array(piece(head, False)), body, F.array(piece(F.lit(END), False)))

    got = got.select("conv_id", F.flatten(F.transform("blocks", merged)).alias("segments"))
    return got.select("conv_id", F.array_join(F.col("segments")["text"], "").alias("formatted"), "segments")


def read_back(formatted: DataFrame) -> DataFrame:
    """What ``format_conversations`` was given: (conv_id, turns array<struct<role, text>>, loss_texts array<string>, formatted)."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")

    def turns_of(b: Column) -> Column:
        at = F.instr(b, "\n")
        role = F.url_decode(F.substring(b, F.lit(len(START) + 1), at - 1 - len(START)))
        texts = F.split(F.substring(b, at + 1, F.length(b)), r"<\|im_sep\|>")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"), loss.alias("loss_texts"))


def digest(back: DataFrame) -> DataFrame:
    """The digest columns of a conversation that was read back."""
    parts = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(parts, ""), 256).alias("turns_sha256"),
        F.array_join("loss_texts", "").alias("__loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select("conv_id", "n_turns", "turns_sha256", F.length("__loss").cast("long").alias("loss_chars"), F.sha2("__loss", 256).alias("loss_sha256"), "formatted_chars")
