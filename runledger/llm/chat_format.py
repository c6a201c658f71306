"""Chat formatting by prefix-target expansion, with DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it are its
context, and only the reply is under the loss mask. Turns that follow the last
reply make one more example without any trainable text, so that the output holds
every turn of every conversation and can be read back.

A turn is written as ``<s>[INST]role[/INST]text</s>``. Where a role or text holds
one of these control strings, a backslash is put behind its first character, also
where backslashes stand there already; taking one away restores the text, so
escaping is reversible for every text. No escaped text holds a control string, and
as each of them begins with a character that none holds further on, none arises
where a text meets a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The control strings of the template.
OPEN, HEAD, TAIL, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
#: Role of the turns that are trained on.
TRAINED = "assistant"

_HELD = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    """``text`` without control strings; :func:`unescape` gives it back."""
    return F.regexp_replace(text, _HELD, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _written(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, n, role, head, reply, stop``: each turn as it is written, and its place.

    ``n`` counts the turns of a conversation from 1; ``head`` and ``reply`` are what
    stands before and in the text, escaped; ``stop`` is the number of characters
    up to the end of the turn, from the start of the conversation.
    """
    turns = conversations.select(
        "conv_id",
        "turn",
        _written("role").alias("role"),
        F.concat(F.lit(OPEN + HEAD), escape(_written("role")), F.lit(TAIL)).alias("head"),
        escape(_written("text")).alias("reply"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "reply")
    width = F.length("head") + F.length("reply") + len(CLOSE)
    return turns.select(
        "conv_id",
        F.row_number().over(order).alias("n"),
        "role",
        "head",
        "reply",
        F.sum(width).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"),
    )


def expand_examples(conversations: DataFrame) -> DataFrame:
    """``conv_id, example_no, n_turns, text, target_start, target_length, complete``.

    One row for each assistant turn of ``conversations`` (conv_id, turn, role, text),
    numbered from 0. ``text`` is the formatted prefix that ends with the reply;
    ``target_start`` (characters from 0) and ``target_length`` are its loss mask, which
    covers the escaped reply alone. ``complete`` marks the example that holds all turns
    of its conversation: that of the last turn, or, where others follow the last reply,
    one more with an empty mask at the end.

    Turns are ordered by ``turn`` (null first), ties by role and escaped text; repeated
    rows are repeated turns. A null role or text is empty. Rows without conv_id are one
    conversation. Further columns are not read; an empty table gives no rows.

    A conversation is held in one row, as its last example is; the others are cut from
    it one by one, so no list of examples is ever in memory.
    """
    last = F.when(F.col("role") == TRAINED, F.col("n"))
    joined = (
        format_turns(conversations)
        .groupBy("conv_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("n", F.concat("head", "reply", F.lit(CLOSE)).alias("written")))
            ).alias("turns"),
            F.sort_array(
                F.collect_list(
                    F.when(
                        F.col("role") == TRAINED,
                        F.struct("n", "stop", F.length("reply").cast("long").alias("target_length")),
                    )
                )
            ).alias("targets"),
            F.max("n").alias("n_all"),
            F.max("stop").alias("stop_all"),
            F.coalesce(F.max(last), F.lit(0)).alias("n_last"),
        )
    )
    rest = F.array(
        F.struct(F.col("n_all").alias("n"), F.col("stop_all").alias("stop"), F.lit(None).cast("long").alias("target_length"))
    )
    targets = F.when(F.col("n_last") == F.col("n_all"), F.col("targets")).otherwise(F.concat("targets", rest))
    examples = joined.select("conv_id", "n_all", "turns.written", F.posexplode(targets).alias("example_no", "t"))
    masked = F.col("t.target_length").isNotNull()
    return examples.select(
        "conv_id",
        F.col("example_no").cast("long").alias("example_no"),
        F.col("t.n").cast("long").alias("n_turns"),
        F.array_join(F.slice("written", F.lit(1), F.col("t.n")), "").alias("text"),
        F.when(masked, F.col("t.stop") - len(CLOSE) - F.col("t.target_length")).otherwise(F.col("t.stop")).alias("target_start"),
        F.coalesce("t.target_length", F.lit(0).cast("long")).alias("target_length"),
        (F.col("t.n") == F.col("n_all")).alias("complete"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    # A turn without role and text still has its marks, so only what follows the last one is empty.
    pieces = F.filter(F.split(text, CLOSE), lambda p: p != "")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, TAIL, 1)
        role = F.substring(head, F.lit(len(OPEN + HEAD) + 1), F.length(head))
        text = F.substring(piece, F.length(head) + len(TAIL) + 1, F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def digests(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from their texts and masks.

    Only the complete example keeps its text here, beside the replies under the masks;
    rows stay where the expansion left them, by conversation.
    """
    under_mask = F.substring("text", (F.col("target_start") + 1).cast("int"), F.col("target_length").cast("int"))
    narrow = examples.select(
        "conv_id",
        F.struct("example_no", under_mask.alias("reply")).alias("reply"),
        F.when(F.col("complete"), F.col("text")).alias("whole"),
        F.length("text").cast("long").alias("chars"),
    )
    held = narrow.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("reply")).alias("replies"),
        F.max("whole").alias("whole"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    turns = held.select(
        "conv_id",
        read_turns(F.col("whole")).alias("turns"),
        F.array_join(F.transform(F.col("replies.reply"), unescape), "").alias("loss"),
        "formatted_chars",
        "n_examples",
    )
    told = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
