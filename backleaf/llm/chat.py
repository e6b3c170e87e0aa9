"""Chat formatting: turns to text with a loss mask, by a declarative template.

A Template names for each role the text before and after a turn and whether its content counts for
the loss, and for each state of a finite-state machine which roles may follow. Formatting gives
segments, each with a loss flag, whose texts joined are the formatted conversation. Control strings
inside a turn are escaped: the first sign of a control string, and the escape sign itself, become
the escape sign and a letter, so no content can open or close a turn and everything reads back.

All of it is DataFrame and SQL functions. A conversation comes out as one row, so its turns meet in
one; nothing else is gathered.

Defined results: a null or empty text is an empty turn; a null role reads as an empty role, and it,
like any role that the template does not name, is no valid turn but is formatted all the same, with
the template's pattern for other roles and no loss; turns are ordered by number (null first), then role,
then text, so ties and repeated rows come in a fixed order and all stay; rows with a null conversation id make one
conversation; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """before + role + middle, the content, after; `next` gives the roles that may follow each state.

    The machine starts in state "" and each turn's role is the next state; "end" in a state's roles
    means that a conversation may end there.
    """

    before: str = "<turn:"
    middle: str = ">\n"
    after: str = "</turn>\n"
    escape: str = "\\"
    loss: frozenset[str] = frozenset({"assistant"})
    next: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "end"),
        }
    )

    def escapes(self) -> list[tuple[str, str]]:
        """What is escaped in a content, in order: the escape sign, then the opening of each control string."""
        shut = self.after.rstrip()
        return [(self.escape, self.escape + "e"), (self.before, self.escape + "o" + self.before[1:]), (shut, self.escape + "c" + shut[1:])]

    def __post_init__(self):
        shut = self.after.rstrip()
        if self.before[:1] in ("", *"eoc", self.escape) or shut[:1] in ("", *"eoc", self.escape) or self.before[0] in self.before[1:] or shut[0] in shut[1:] or len(self.escape) != 1:
            raise ValueError("control strings must start with a sign of their own, other than the escape and its letters")


def escaped(text: Column, t: Template) -> Column:
    for plain, coded in t.escapes():
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescaped(text: Column, t: Template) -> Column:
    (_, sign), (_, opening), (_, closing) = t.escapes()
    text = F.replace(text, F.lit(closing[:2]), F.lit(t.after[0]))
    text = F.replace(text, F.lit(opening[:2]), F.lit(t.before[0]))
    return F.replace(text, F.lit(sign), F.lit(t.escape))


def escaped_role(role: Column, t: Template) -> Column:
    """A role's escape also covers the end of the role."""
    return F.replace(escaped(role, t), F.lit(t.middle[0]), F.lit(t.escape + "m"))


def unescaped_role(role: Column, t: Template) -> Column:
    return unescaped(F.replace(role, F.lit(t.escape + "m"), F.lit(t.middle[0])), t)


def format_chats(df: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: conv_id, n_turns, valid, error_turn, segments, formatted.

    valid: the machine went through all turns and may end where it stands; error_turn: how many
    turns came before the first that the machine does not allow (n_turns: it may not end there),
    null if valid. segments: array of (text, loss). formatted: the segments' texts joined.
    """
    turn = F.struct(df[turn_col].alias("turn"), F.coalesce(df[role_col], F.lit("")).alias("role"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    convs = df.groupBy(df[conv_col].alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    allowed = F.create_map(*[x for state, roles in template.next.items() for x in (F.lit(state), F.array(*map(F.lit, roles)))])
    start = F.struct(F.lit("").alias("state"), F.lit(True).alias("ok"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, t: Column) -> Column:
        ok = s["ok"] & F.coalesce(F.array_contains(F.try_element_at(F.col("allowed"), s["state"]), t["role"]), F.lit(False))
        return F.struct(t["role"].alias("state"), ok.alias("ok"), (s["n"] + ok.cast("long")).alias("n"))

    convs = convs.withColumn("allowed", allowed).withColumn("run", F.aggregate("turns", start, step))
    may_end = F.coalesce(F.array_contains(F.try_element_at(F.col("allowed"), F.col("run.state")), "end"), F.lit(False))
    convs = convs.withColumn("valid", F.col("run.ok") & may_end)

    def parts(t: Column) -> Column:
        segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(template.before), escaped_role(t["role"], template), F.lit(template.middle))
        return F.array(segment(head, F.lit(False)), segment(escaped(t["text"], template), t["role"].isin(*template.loss)), segment(F.lit(template.after), F.lit(False)))

    convs = convs.withColumn("segments", F.flatten(F.transform("turns", parts)))
    return convs.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        "valid",
        F.when(~F.col("valid"), F.col("run.n")).alias("error_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: Column, t: Template = Template()) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    body = F.split(formatted, "\\Q" + t.after + "\\E")
    turns = F.slice(body, F.lit(1), F.size(body) - 1)
    middle = len(t.before) + 1

    def turn(x: Column) -> Column:
        at = F.position(F.lit(t.middle), x)
        role = F.substr(x, F.lit(middle), at - middle)
        return F.struct(unescaped_role(role, t).alias("role"), unescaped(F.substr(x, at + len(t.middle)), t).alias("text"))

    return F.transform(turns, turn)


def loss_text(segments: Column, t: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
