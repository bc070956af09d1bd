"""Readings of JSON in model replies, as column expressions that give null for what can't be read."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.functions.text import strip_fences

VERDICT = "struct<winner:string,confidence:double,reason:string,scores:map<string,map<string,double>>>"
PAIRWISE = "struct<winner:string,confidence:double,reasoning:string,criteria_scores:map<string,map<string,double>>>"
# The winners that a ranking verdict may name, those of a pairwise one, and the default confidence.
RANKING_WINNERS = ["A", "B", "tie"]
PAIRWISE_WINNERS = ["Model A", "Model B", "Tie"]
DEFAULT_CONFIDENCE = 3.0
#: Events kept of a reply.
MOST_EVENTS = 10


def cleaned(text: Column) -> Column:
    """Without fences, on one line, with JSON's spelling of truth values."""
    line = F.trim(F.regexp_replace(strip_fences(text), r"\s+", " "))
    return F.replace(F.replace(line, F.lit("True"), F.lit("true")), F.lit("False"), F.lit("false"))


def best_effort(text: Column, schema: str) -> Column:
    """A struct from JSON, from a literal with single quotes, or from a body without braces that names events; else null."""
    t = cleaned(text)
    quoted = F.replace(t, F.lit("'"), F.lit('"'))
    braced = F.when(~t.startswith("{") & F.contains(t, F.lit("events")), F.concat(F.lit("{"), t, F.lit("}")))
    read = lambda c: F.when(c.startswith("{") & F.try_parse_json(c).isNotNull(), F.from_json(c, schema))
    return F.coalesce(read(t), read(quoted), read(braced), read(F.replace(braced, F.lit("'"), F.lit('"'))))


def events(text: Column, most: int = MOST_EVENTS) -> Column:
    """The events of a reply: trimmed, without blank ones, at most so many; null if it has no list of them."""
    found = best_effort(text, "struct<events:array<string>>")["events"]
    return F.slice(F.filter(F.transform(found, lambda e: F.regexp_replace(e, r"^\s+|\s+$", "")), lambda e: e != ""), F.lit(1), F.lit(most))


def relations(text: Column) -> Column:
    """array of struct(event, relationship, reason) of a judge's reply."""
    return best_effort(text, "struct<events:array<struct<event:string,relationship:string,reason:string>>>")["events"]


def _once(value: Column, body) -> Column:
    """body(value), with value read once."""
    return F.get(F.transform(F.array(value), body), 0)


def verdict(text: Column) -> Column:
    """struct(winner, confidence, reason, scores, status) of a ranking verdict: a winner that isn't allowed or a reply that can't be read is an `error`."""

    def checked(read: Column) -> Column:
        fine = F.coalesce(read["winner"].isin(*RANKING_WINNERS), F.lit(False))
        return F.struct(
            F.when(fine, read["winner"]).otherwise("error").alias("winner"), F.when(fine, F.coalesce(read["confidence"], F.lit(DEFAULT_CONFIDENCE))).alias("confidence"), F.when(fine, F.coalesce(read["reason"], F.lit(""))).alias("reason"),
            F.when(fine, F.coalesce(read["scores"], F.create_map().cast("map<string,map<string,double>>"))).alias("scores"), F.when(fine, "ok").otherwise("error").alias("status"),
        )

    return _once(strip_fences(text), lambda body: _once(F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, VERDICT)), checked))


def readable_verdict(reply: str) -> bool:
    """Whether verdict can read a reply, for those who may ask again."""
    body = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", reply or "")
    try:
        return json.loads(body).get("winner") in RANKING_WINNERS
    except (ValueError, AttributeError, TypeError):
        return False


def pairwise(text: Column) -> Column:
    """struct(winner, confidence, reasoning, status) of a pairwise verdict: one that can't be read, or lacks winner or confidence, is a Tie of confidence 0."""

    def checked(read: Column) -> Column:
        fine = F.coalesce(read["winner"].isNotNull() & read["confidence"].isNotNull(), F.lit(False))
        known = F.when(read["winner"].isin(*PAIRWISE_WINNERS), read["winner"]).otherwise("Tie")
        return F.struct(
            F.when(fine, known).otherwise("Tie").alias("winner"), F.when(fine, read["confidence"]).otherwise(0.0).alias("confidence"), F.when(fine, F.coalesce(read["reasoning"], F.lit(""))).alias("reasoning"), F.when(fine, "ok").otherwise("parse_error").alias("status"),
        )

    return _once(strip_fences(text), lambda body: _once(F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, PAIRWISE)), checked))


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and without white space between values; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))
