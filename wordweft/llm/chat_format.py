"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

A template names, for each role, the control string that opens its turn; steps lead from a state and a role to the next
state, and states, not roles, say whether a turn's text counts for the loss. Every turn's segments are emitted by the state that the machine
enters with it. A role that the state has no step for is refused: the first place is reported, and the machine goes on
from the role's own state, so that the rest is formatted and checked too. One control string closes every turn. Control strings
inside texts are escaped: every backslash is doubled and every control string gets a backslash after its first character, so that
an escaped text holds no control string; undoing drops one backslash from each. Roles that open nothing are
written out, escaped, between two markers.

Defined results: null text or role counts as empty; turns of a conversation are ordered by turn (null first), role, text;
repeated rows are repeated turns; rows with a null conv_id form one conversation; extra columns are ignored. A conversation
whose turn order the machine refuses is still formatted, with valid = false and the first refused place in error_at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordweft.llm.common import let


@dataclass(frozen=True)
class Template:
    opens: dict[str, str]
    close: str
    loss: frozenset[str]
    other: tuple[str, str] = ("<|role|>", "<|text|>")
    start: str = "start"
    steps: dict[tuple[str, str], str] = field(default_factory=dict)
    accepts: frozenset[str] = frozenset()

    @property
    def controls(self) -> list[str]:
        """All control strings, longest first."""
        return sorted({*self.opens.values(), self.close, *self.other}, key=lambda x: (-len(x), x))

    @property
    def states(self) -> list[str]:
        """States that turns lead to, and one for roles without any."""
        return [*sorted({*self.steps.values()}), ""]

    def entered(self, role: str) -> str:
        """Where a refused role goes on: the state of its own name, else the first that it leads to."""
        led = [to for (_, r), to in self.steps.items() if r == role]
        return role if role in led else led[0] if led else ""


#: Roles and the turn order: an optional system turn, then user and assistant by turns, ending with the assistant.
INSTRUCT = Template(
    opens={"system": "<<SYS>>", "user": "[INST]", "assistant": "[/INST]"},
    close="</s>",
    loss=frozenset({"assistant"}),
    steps={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    accepts=frozenset({"assistant"}),
)


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _opening(role: Column, template: Template) -> Column:
    a, b = template.other
    out = F.concat(F.lit(a), escape(role, template), F.lit(b))
    for name, mark in template.opens.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def format_conversations(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row a conversation: segments (text, loss), formatted, loss_spans (code points, end exclusive), valid, error_at.

    A fold runs the machine over the turns and notes one letter a turn, for the state entered; segments follow from these letters.
    """
    letter = {state: chr(ord("A") + i) for i, state in enumerate(template.states)}
    table = lambda pairs: F.create_map(*(F.lit(x) for pair in pairs for x in pair))
    moves = table((f"{state}>{role}", to) for (state, role), to in template.steps.items())
    resume = table((role, template.entered(role)) for role in dict.fromkeys(r for _, r in template.steps))
    letters = table(letter.items())
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    never = F.lit(False)

    def emitted(t: Column, state: Column) -> Column:
        learnt = state.isin(*(letter[x] for x in sorted(template.loss) if x in letter))
        return F.array(piece(_opening(t["role"], template), never), piece(escape(t["text"], template), learnt), piece(F.lit(template.close), never))

    grouped = turns.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    ).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    walk = F.aggregate(
        "turns",
        F.struct(F.lit(template.start).alias("state"), F.lit("").alias("path"), F.lit(None).cast("int").alias("error_at")),
        lambda s, t: let(
            F.try_element_at(moves, F.concat(s["state"], F.lit(">"), t["role"])),
            lambda to: let(
                F.coalesce(to, F.try_element_at(resume, t["role"]), F.lit("")),
                lambda state: F.struct(
                    state.alias("state"),
                    F.concat(s["path"], F.try_element_at(letters, state)).alias("path"),
                    F.coalesce(s["error_at"], F.when(to.isNull(), F.length(s["path"]))).alias("error_at"),
                ),
            ),
        ),
    )
    walked = grouped.select("conv_id", "turns", walk.alias("walk")).withColumn("path", F.split("walk.path", ""))
    built = walked.select("conv_id", "walk", F.flatten(F.transform("turns", lambda t, i: emitted(t, F.get("path", i)))).alias("segments"))
    spans = F.aggregate(
        "segments",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, x: let(
            s["at"] + F.length(x["text"]),
            lambda end: F.struct(end.alias("at"), F.when(x["loss"], F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), end.alias("end"))))).otherwise(s["spans"]).alias("spans")),
        ),
    )["spans"]
    return built.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        (F.col("walk.error_at").isNull() & F.col("walk.state").isin(*sorted(template.accepts))).alias("valid"),
        F.col("walk.error_at").alias("error_at"),
    )


def read_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns (role, text) of a formatted conversation: no escaped text holds the closing string, so splitting there is exact."""
    quoted = "\\Q" + template.close + "\\E"
    a, b = template.other

    def turn(p: Column) -> Column:
        cut_at = F.locate(b, p)
        out = F.struct(unescape(F.substring(p, F.lit(len(a) + 1), cut_at - len(a) - 1)).alias("role"), unescape(F.substring(p, cut_at + len(b), F.length(p))).alias("text"))
        for name, mark in template.opens.items():
            out = F.when(F.startswith(p, F.lit(mark)), F.struct(F.lit(name).alias("role"), unescape(F.substring(p, F.lit(len(mark) + 1), F.length(p))).alias("text"))).otherwise(out)
        return out

    pieces = F.split(formatted, quoted)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("x")).select("x.*")
    done = format_conversations(turns.unionByName(extra)).select("conv_id", "formatted", "loss_spans")
    read = done.withColumn("read", read_turns(F.col("formatted"))).withColumn(
        "learnt", F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    )
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
