"""Chat formatting by a declarative template, with DataFrame functions alone."""

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values of the template: control strings around a turn, which all begin with the marker, of two
#: characters; the roles whose text is learned. The states of a conversation are its last role (none at
#: first): the moves that are valid, and the states that may end it.
TEMPLATE = {
    "marker": "<|", "open": "<|im_start|>", "after_role": "\n", "close": "<|im_end|>\n", "role_feed": "<|nl|>", "learned": ["assistant"],
    "moves": {"": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]}, "ends": ["user", "assistant"],
}


def _checked(template: dict) -> dict:
    marker = template["marker"]
    if len(marker) != 2 or "\\" in marker or not all(template[c].startswith(marker) for c in ("open", "close", "role_feed")):
        raise ValueError("the control strings of a template begin with its marker, of two characters")
    return template


def _ends(template: dict) -> tuple[str, str]:
    return tuple(_literal(c) for c in template["marker"])


def _plain(text: str) -> str:
    """For the replacement of a regular expression."""
    return "".join(f"\\{c}" if c in "\\$" else c for c in text)


def escaped(text: Column, template: dict = TEMPLATE) -> Column:
    """`text` with one backslash more between the marker's characters, wherever they stand with backslashes alone between; so no marker is left."""
    a, b = _ends(template)
    # What follows is only looked at: the second character may begin the next marker.
    return F.regexp_replace(text, rf"{a}(\\*)(?={b})", rf"{_plain(template['marker'][0])}\\$1")


def unescaped(text: Column, template: dict = TEMPLATE) -> Column:
    """Takes the one backslash more away again."""
    a, b = _ends(template)
    return F.regexp_replace(text, rf"{a}\\(\\*)(?={b})", rf"{_plain(template['marker'][0])}$1")


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def format_chats(turns: DataFrame, template: dict = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, n_turns, valid, segments): each conversation as text segments with loss flags.

    A turn is open, role, after_role (no loss), the escaped text (loss for learned roles)
    and close (no loss); the segments put together are the formatted text. Turns are sorted
    by turn, role and text, null turns last; a null text is empty and a null role is the
    empty role. valid: a state machine over the roles accepts their order. Rows with a null
    conversation id form one conversation. Other columns are not read; an empty table gives
    an empty result. One conversation becomes one row, so its size is bounded by that of a row.
    """
    template = _checked(template)
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    said = escaped(text, template)
    head = F.concat(F.lit(template["open"]), F.replace(escaped(role, template), F.lit(template["after_role"]), F.lit(template["role_feed"])), F.lit(template["after_role"]))
    row = F.struct(F.col(turn_col).isNull().alias("late"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("raw"), head.alias("head"), said.alias("said"))
    chats = turns.select(F.col(conv_col), row.alias("row")).groupBy(conv_col).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    no, learned = F.lit(False), [F.lit(r) for r in template["learned"]]
    parts = F.flatten(F.transform("rows", lambda r: F.array(_segment(r["head"], no), _segment(r["said"], r["role"].isin(*learned) if learned else no), _segment(F.lit(template["close"]), no))))
    moves = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in template["moves"].items() for x in pair))
    stuck = F.lit("\x00")
    end = F.aggregate("rows", F.lit(""), lambda state, r: F.when(F.coalesce(F.array_contains(F.try_element_at(moves, state), r["role"]), no), r["role"]).otherwise(stuck))
    return chats.select(conv_col, F.size("rows").cast("bigint").alias("n_turns"), end.isin(*template["ends"]).alias("valid"), parts.alias("segments"))


def formatted_text(segments: Column) -> Column:
    """The whole formatted text of a segment list."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """array<struct<role, text>> of a formatted text: the turns as they were given.

    Control strings never occur in escaped texts, so the text is cut at them.
    """
    chunks = F.filter(F.split(formatted, _literal(template["open"])), lambda c: c != "")

    def turn(chunk: Column) -> Column:
        role = F.substring_index(chunk, template["after_role"], 1)
        said = F.substring(chunk, F.length(role) + len(template["after_role"]) + 1, F.length(chunk) - F.length(role) - len(template["after_role"]) - len(template["close"]))
        return F.struct(unescaped(F.replace(role, F.lit(template["role_feed"]), F.lit(template["after_role"])), template).alias("role"), unescaped(said, template).alias("text"))

    return F.transform(chunks, turn)


def _literal(text: str) -> str:
    return "".join(f"\\{c}" if c in "|.?*+()[]{}^$\\" else c for c in text)


def chat_digests(chats: DataFrame, conv_col: str = "conv_id", template: dict = TEMPLATE) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid), all read back from the formatted output."""
    text = chats.select(conv_col, "valid", "segments", formatted_text(F.col("segments")).alias("formatted"))
    read = text.select(conv_col, "valid", F.length("formatted").cast("bigint").alias("formatted_chars"), read_back(F.col("formatted"), template).alias("turns"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "").alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(conv_col, F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "valid")
