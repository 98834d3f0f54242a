"""Chat formatting: a finite-state machine over roles and a declarative template.

The template names the marks around a turn, the roles whose text is trained on,
and which role may follow which. Every turn becomes three segments (opening
mark, text, closing mark), each with its own loss flag. Control strings inside
a text are escaped, so the formatted stream can be parsed back exactly.

Edge cases: a null text or role is an empty string (an empty role is in no
transition, so its conversation is invalid); turns with equal numbers follow
by role, then text; a null conversation id is a conversation of its own;
repeated rows are repeated turns; an empty table gives an empty result.
Invalid conversations are formatted too and flagged, never dropped.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``escape`` stands before any of ``escaped`` in a text; ``opening`` and ``closing`` start with an escaped character."""

    opening: tuple[str, str] = ("### ", ": ")
    closing: str = "</turn>\n"
    escape: str = "\\"
    escaped: str = "\\#<"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: tuple[str, ...] = ("system", "user")
    after: dict = field(default_factory=lambda: {"system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


CHAT = Template()


def segments(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, place, seg, text, loss, allowed, last): three rows per turn, in order of place and seg.

    ``allowed`` tells whether the role may stand here; ``last`` is the role of the last turn of the conversation.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "role", "text", F.row_number().over(ordered).alias("place"), F.lag("role").over(ordered).alias("before"),
                       F.lead("role").over(ordered).alias("next"))
    allowed = F.col("before").isNull() & F.col("role").isin(*template.start)
    for role, following in template.after.items():
        allowed = allowed | (F.coalesce(F.col("before") == role, F.lit(False)) & F.col("role").isin(*following))
    ends = F.col("next").isNotNull() | F.col("role").isin(*template.final)

    def escaped(col: str, also: str = ""):
        chars = "".join("\\" + c for c in template.escaped + also)
        return F.regexp_replace(col, f"([{chars}])", re.escape(template.escape) + "$1")

    def segment(text, loss):
        return F.struct(text.alias("text"), loss.alias("loss"))

    parts = F.array(segment(F.concat(F.lit(template.opening[0]), escaped("role", template.opening[1][0]), F.lit(template.opening[1])), F.lit(False)),
                    segment(escaped("text"), F.col("role").isin(*template.loss_roles)),
                    segment(F.lit(template.closing), F.lit(False)))
    return rows.select("conv_id", "place", (allowed & ends).alias("allowed"), F.posexplode(parts).alias("seg", "s")).select(
        "conv_id", "place", "seg", "s.text", "s.loss", "allowed")


def validity(segs: DataFrame) -> DataFrame:
    """(conv_id, valid): whether the machine accepts the conversation's roles."""
    return segs.groupBy("conv_id").agg(F.bool_and("allowed").alias("valid"))


READ_BACK = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"


def read_back(segs: DataFrame, template: Template = CHAT) -> DataFrame:
    """Parse formatted conversations from the stream of their segments; one row per conversation.

    Each task streams over its conversations in order and holds one turn at a time.
    """
    one = "\\" + template.escape
    body = rf"((?:[^{one}{template.closing[0]}]*(?:{one}.[^{one}{template.closing[0]}]*)*))"
    name = rf"((?:[^{one}{template.opening[1][0]}]*(?:{one}.[^{one}{template.opening[1][0]}]*)*))"
    turn = re.compile(re.escape(template.opening[0]) + name + re.escape(template.opening[1]) + body + re.escape(template.closing), re.S)
    plain = re.compile(one + "(.)", re.S)
    closing = template.closing

    def parse(batches):
        out, current = [], None

        def close():
            if current["rest"]:
                raise ValueError(f"conversation {current['conv']}: unparsed {current['rest'][:80]!r}")
            out.append((current["conv"], current["n"], current["turns"].hexdigest(), current["lossc"], current["loss"].hexdigest(), current["chars"], current["ok"]))

        def table():
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=list(names))

        for batch in batches:
            for conv, text, loss, ok in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "allowed"))):
                if current is None or current["conv"] != conv:
                    if current is not None:
                        close()
                    current = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "lossc": 0, "loss": hashlib.sha256(), "chars": 0, "rest": "", "ok": True}
                current["chars"] += len(text)
                current["rest"] += text
                current["ok"] &= ok
                if loss:
                    said = plain.sub(r"\1", text)
                    current["lossc"] += len(said)
                    current["loss"].update(said.encode())
                while current["rest"].endswith(closing) and (m := turn.match(current["rest"])):
                    current["rest"] = current["rest"][m.end():]
                    current["n"] += 1
                    current["turns"].update("".join(plain.sub(r"\1", x) + "\n" for x in m.groups()).encode())
            if len(out) >= 1000:
                yield table()
                out.clear()
        if current is not None:
            close()
        yield table()

    dealt = segs.repartition("conv_id").sortWithinPartitions("conv_id", "place", "seg")
    return dealt.select("conv_id", "text", "loss", "allowed").mapInArrow(parse, READ_BACK)
