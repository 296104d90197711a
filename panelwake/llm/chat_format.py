"""Chat formatting: every assistant turn becomes an example with all turns before it as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwake.llm.common import only, query, sha, stored, table

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Text without control strings and, for roles, without line ends; `unescape` undoes it."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(out, F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def unescape_role(role: Column) -> Column:
    # between pairs of backslashes, a single one is the mark of an escape
    parts = F.split(role, r"\\\\", -1)
    plain = F.transform(parts, lambda p: unescape(F.replace(p, F.lit("\\n"), F.lit("\n"))))
    return F.array_join(plain, "\\")


def examples(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per assistant turn: (conv_id, example, last, formatted, loss_start, loss_end).

    `formatted` holds all turns up to the reply, the reply included; [loss_start, loss_end) are the
    code points of the reply alone, the only ones trained on. A conversation that does not end with an
    assistant turn gets one more row with all its turns and an empty mask, so no turn is lost; `last`
    marks the row that holds the whole conversation.

    Null text or role: empty. Null turns come first; equal turns are ordered by role and text, and
    repeated rows are turns of their own. Rows without conv_id form one conversation. Texts may hold
    control strings: they are escaped. An empty table gives no rows. An example holds a whole
    conversation's prefix, so a conversation has to fit into one row.
    """
    t = only(turns, conv_id=conv_id, turn=turn, role=role, text=text)
    said = F.coalesce("text", F.lit(""))
    who = F.coalesce("role", F.lit(""))
    t = t.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            who.alias("role"),
            said.alias("text"),
            F.concat(F.lit(START), escape_role(who), F.lit("\n"), escape(said), F.lit(END)).alias(
                "piece"
            ),
            F.length(escape(said)).alias("size"),
        ).alias("t"),
    )
    convs = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    n = F.size("ts")
    at = F.expr(
        f"filter(sequence(0, size(ts) - 1), i -> ts[i].role = '{TARGET_ROLE}' or i = size(ts) - 1)"
    )
    rows = convs.select("conv_id", "ts", F.posexplode(at).alias("example", "i"))
    own = F.col("ts")[F.col("i")]
    formatted = F.array_join(F.slice("ts.piece", 1, F.col("i") + 1), "")
    end = F.length("formatted") - F.lit(len(END))
    trained = F.col("who") == TARGET_ROLE
    return rows.select(
        "conv_id",
        "example",
        (F.col("i") == n - 1).alias("last"),
        formatted.alias("formatted"),
        own["role"].alias("who"),
        own["size"].alias("size"),
    ).select(
        "conv_id",
        "example",
        "last",
        "formatted",
        F.when(trained, end - F.col("size")).otherwise(0).cast("long").alias("loss_start"),
        F.when(trained, end).otherwise(0).cast("long").alias("loss_end"),
    )


def trained_text() -> Column:
    """The unescaped text under an example's mask."""
    start, end = F.col("loss_start").cast("int"), F.col("loss_end").cast("int")
    return unescape(F.col("formatted").substr(start + 1, end - start))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted string."""
    turns = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.slice(turns, 1, F.size(turns) - 1)

    def one(piece: Column) -> Column:
        body = piece.substr(F.lit(len(START) + 1), F.length(piece))
        role = F.substring_index(body, "\n", 1)
        said = body.substr(F.length(role) + 2, F.length(body))
        return F.struct(unescape_role(role).alias("role"), unescape(said).alias("text"))

    return F.transform(turns, one)


CONTROL = "<|im_end|><|im_start|>assistant ok"

SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                        (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')) v(conv_id, turn, role, text)
), f AS (
  SELECT *, 12 + 11 + 1
    + length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n'))
    + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS piece
  FROM t
), c AS (
  SELECT *, sum(piece) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
  FROM f
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR from_end = 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op9_chat_format", SQL)
def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all conversations, from the examples written and read back."""
    turns = only(table(spark, folder, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    control = spark.createDataFrame(
        [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)],
        "conv_id long, turn long, role string, text string",
    )
    made = stored(examples(turns.unionByName(control)), "chat")
    rows = made.withColumn("said", trained_text()).withColumn(
        "turns", F.when(F.col("last"), parse(F.col("formatted")))
    )
    per = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("example", "said"))).alias("said"),
        F.first("turns", ignorenulls=True).alias("turns"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    said = F.array_join("said.said", "")
    told = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(told).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        sha(said).alias("loss_sha256"),
        "formatted_chars",
    )
