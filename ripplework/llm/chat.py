"""Chat formatting, in DataFrame functions alone: a finite-state machine over roles, and a declarative template.

A template names what stands before and after a turn's text and which roles' texts are under the loss. The
machine's transitions say which role may follow which; a conversation is valid if every step is a transition
and it ends in a final role. Invalid ones are formatted as well, with valid = false.

Control strings are "<|name|>". Inside a text, "<|", or "<" and "|" with backslashes between them, gets one
backslash more, so a text can't contain a control string, and taking one backslash away restores it exactly;
all other text stays as it is. Role names are escaped likewise, "|>" in them too.

A conversation is the unit of output: its turns are gathered into one row, in order of (turn, role, text), so
repeated rows and ties stay, side by side. Null text and null roles are empty. Rows without conv_id form one
conversation. Further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    before: str = "<|{role}|>\n"
    after: str = "<|end|>\n"
    loss: tuple[str, ...] = ("assistant",)
    steps: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, "<(\\\\*)\\|", "<\\\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "<\\\\(\\\\*)\\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), "\\|(\\\\*)>", "|\\\\$1>")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, "\\|\\\\(\\\\*)>", "|$1>"))


def valid(roles: Column, template: Template) -> Column:
    """Run the machine; a step that isn't a transition leads to a state that nothing leaves."""
    steps = F.create_map(*[F.lit(x) for a, follows in template.steps.items() for b in follows for x in (f"{a}\n{b}", b)])
    state = F.aggregate(roles, F.lit(""), lambda s, r: F.coalesce(F.try_element_at(steps, F.concat(s, F.lit("\n"), r)), F.lit("\n")))
    return state.isin(*template.final)


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, valid, segments (text, loss) and formatted, their texts joined, from rows (conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    head, tail = template.before.split("{role}")
    made = F.flatten(F.transform("turns", lambda t: F.array(
        segment(F.concat(F.lit(head), escape_role(t["role"]), F.lit(tail)), F.lit(False)),
        segment(escape(t["text"]), t["role"].isin(*template.loss)),
        segment(F.lit(template.after), F.lit(False)),
    )))
    formed = turns.select("conv_id", valid(F.transform("turns", lambda t: t["role"]), template).alias("valid"), made.alias("segments"))
    return formed.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation."""
    head, tail = template.before.split("{role}")
    parts = F.split(formatted, "\\Q" + template.after + "\\E", -1)
    rest = lambda p: F.substr(p, F.lit(len(head) + 1))
    role = lambda p: F.substring_index(rest(p), tail, 1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(unescape_role(role(p)).alias("role"), unescape(F.substr(rest(p), F.char_length(role(p)) + len(tail) + 1)).alias("text")))


def digest(formed: DataFrame, template: Template = Template()) -> DataFrame:
    """Counts and checksums, read back from the formatted text and the segments."""
    read = formed.select("conv_id", "valid", "formatted", parse(F.col("formatted"), template).alias("read"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("learned"))
    joined = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


#: A conversation whose texts hold another template's control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

ORACLE = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learned,
    string_agg(role || ',', '' ORDER BY turn, role, text) AS roles,
    sum(5 + 8 + length(role) + length(text) + len(regexp_extract_all(text, '<\\\\*\\|'))) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, regexp_full_match(roles, '(system,)?(user,assistant,)+') AS valid
FROM g
"""
