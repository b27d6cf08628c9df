r"""Chat formatting: typed content parts, an escaped template and a loss mask.

A message is a role and a list of typed parts. A visitor walks the parts in order
and flattens them to text: text parts as they are, image, audio and document parts
as one placeholder each. It records each attachment (turn, part, kind, reference,
placeholder's offset in the conversation, expanded tokens): images count tiles of `TILE` pixels, audio
`AUDIO_RATE` tokens a second, documents `PAGE_TOKENS` a page.

A conversation is the concatenation of its turns, each

    ### {role}: {text}</turn>\n

Control strings inside a text are broken by a backslash, and backslashes doubled, so
that a marker in the output is always a real one and reading back is exact:
backslash -> two, `</turn>` -> `<\/turn>`, `### ` -> `##\# `, and the openings of
placeholders `<|` -> `<\|`. Roles are percent-encoded.

Everything is a DataFrame expression. A conversation is one string by definition;
conversations are spread over tasks, turns are gathered per conversation only.

Defined results: a null text or part is empty; a null role is the empty role; turns
are ordered by turn (null first), ties by role, then text; repeated rows are repeated
turns; a null conv_id is a conversation of its own. Empty tables give empty results.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TILE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512
OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<part:int,kind:string,ref:string,offset:bigint,n_tokens:bigint>"
VISITED = f"struct<part:int,body:string,held:string,files:array<{ATTACHMENT}>>"
FILES = ("image", "audio", "document")


def text_parts(text: Column) -> Column:
    """A message that is only text, as typed parts."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    )


def escape(text: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("</turn>", "<\\/turn>"), ("### ", "##\\# "), ("<|", "<\\|")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    """Drops each escaping backslash; texts without one don't reach the pattern."""
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def _kind(p: Column) -> Column:
    return F.coalesce(F.lower(p["type"]), F.lit("text"))


def part_tokens(p: Column) -> Column:
    """Tokens that a placeholder expands to; text parts and unknown sizes are 0."""
    side = lambda c: F.ceil(F.coalesce(p[c], F.lit(0)) / TILE)
    return (
        F.when(_kind(p) == "image", side("width") * side("height"))
        .when(_kind(p) == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(_kind(p) == "document", F.coalesce(p["pages"], F.lit(0)).cast("long") * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def _parts(parts: Column) -> Column:
    return F.coalesce(parts, F.array().cast(f"array<{PART}>"))


def _placeholder(p: Column) -> Column:
    return F.concat(F.lit("<|"), _kind(p), F.lit("|>"))


def plain(parts: Column) -> Column:
    """A message's text before escaping, placeholders in it."""
    return F.array_join(F.transform(_parts(parts), lambda p: F.when(_kind(p).isin(*FILES), _placeholder(p)).otherwise(F.coalesce(p["text"], F.lit("")))), "")


def visit(parts: Column) -> Column:
    """A message's parts in order as struct (body, files): text parts that follow each other are escaped as one.

    `body` is the escaped text with a placeholder per attachment; `files` has an entry for each of these: part (its
    place), kind, ref, offset (code points before its placeholder in the body), n_tokens.
    """
    start = F.struct(
        F.lit(0).alias("part"), F.lit("").alias("body"), F.lit("").alias("held"), F.array().cast(f"array<{ATTACHMENT}>").alias("files")).cast(VISITED)

    def step(v: Column, p: Column) -> Column:
        done = F.concat(v["body"], escape(v["held"]))
        entry = F.struct(
            v["part"].alias("part"), _kind(p).alias("kind"), p["ref"].alias("ref"), F.char_length(done).cast("long").alias("offset"),
            part_tokens(p).alias("n_tokens"))
        held = F.concat(v["held"], F.coalesce(p["text"], F.lit("")))
        file = F.struct(v["part"] + 1, F.concat(done, _placeholder(p)), F.lit(""), F.concat(v["files"], F.array(entry))).cast(VISITED)
        text = F.struct(v["part"] + 1, v["body"], held, v["files"]).cast(VISITED)
        return F.when(_kind(p).isin(*FILES), file).otherwise(text)

    return F.aggregate(_parts(parts), start, step, lambda v: F.struct(
        F.concat(v["body"], escape(v["held"])).alias("body"), v["files"].alias("files")))


def format_conversations(
    messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
    *, learn: str = "assistant",
) -> DataFrame:
    """Per conversation: conv_id, formatted, spans (start, length of each learned text, code points), attachments, expanded_tokens."""
    rows = messages.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        plain(F.col(parts)).alias("plain"), visit(F.col(parts)).alias("v"),
    )
    rows = rows.select(
        "conv_id", "turn", "role", "plain", F.concat(F.lit(OPEN), F.url_encode("role"), F.lit(SEP)).alias("head"),
        F.col("v.body").alias("body"), F.col("v.files").alias("files"),
    ).withColumns({"before": F.char_length("head").cast("long"), "own": F.char_length("body").cast("long")})
    # Places and offsets by running sums over the conversation's rows, in the exchange that gathers them anyway.
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "plain", "body", F.to_json("files"))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({
        "message": F.row_number().over(order) - 1,
        "start": F.coalesce(F.sum(F.col("before") + F.col("own") + len(CLOSE)).over(upto), F.lit(0)) + F.col("before"),
    })
    one = F.struct("message", "start", "own", "role", F.concat("head", "body", F.lit(CLOSE)).alias("text"), "files")
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda m: m["role"] == learn), lambda m: F.struct(m["start"].alias("start"), m["own"].alias("length")))
    files = F.flatten(F.transform("turns", lambda m: F.transform(m["files"], lambda f: F.struct(
        m["message"].alias("message"), f["part"].alias("part"), f["kind"].alias("kind"), f["ref"].alias("ref"),
        (m["start"] + f["offset"]).alias("offset"), f["n_tokens"].alias("n_tokens")))))
    return turns.select(
        "conv_id", F.array_join(F.transform("turns", lambda m: m["text"]), "").alias("formatted"), spans.alias("spans"), files.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, f: n + f["n_tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            F.url_decode(F.substring(x, F.lit(len(OPEN) + 1), F.instr(x, SEP) - len(OPEN) - 1)).alias("role"),
            unescape(F.substring(x, F.instr(x, SEP) + len(SEP), F.char_length(x))).alias("text"),
        ),
    )


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
