r"""Message triage by weighted rules, and amounts and deadlines named in a message.

All rules are literal patterns in one projection. Words and digits count as Unicode's, as `(?U)` asks.
Weights are in hundredths; a rule counts once, sums stop at 100.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.priorities import basis_priorities
from millrace.sources.shared import spread


@dataclass(frozen=True)
class Signal:
    name: str
    weight: int
    regex: str


# The patterns and weights that verdicts are defined by, in order.
SCAM = (
    Signal("urgency", 20, r"\b(?:urgent|immediately|within 24 hours|final notice|act now|last warning)\b"),
    Signal("account_threat", 20, r"\b(?:suspend|suspended|terminate|deactivat|locked|closed) (?:your )?account\b"),
    Signal("gift_card", 35, r"\b(?:gift card|itunes card|google play card|steam card)\b"),
    Signal("irreversible_payment", 30, r"\b(?:wire transfer|western union|moneygram|bitcoin|crypto|e-?transfer)\b"),
    Signal("verify_details", 25, r"\b(?:verify|confirm|update) (?:your )?(?:identity|account|password|payment|billing)\b"),
    Signal("link_push", 10, r"\b(?:click|tap) (?:here|this link|below)\b"),
    Signal("legal_threat", 30, r"\b(?:warrant|arrest|legal action|lawsuit|police|deport)\b"),
    Signal("windfall", 30, r"\b(?:you have won|prize|lottery|inheritance|beneficiary|unclaimed funds)\b"),
    Signal("refund_bait", 20, r"\b(?:refund|overpayment|rebate) (?:is )?(?:pending|available|owed)\b"),
    Signal("secrecy", 30, r"\b(?:do not tell|keep this confidential|between us)\b"),
    Signal("remote_control", 35, r"\b(?:remote access|anydesk|teamviewer|install (?:this|our) (?:app|software))\b"),
    Signal("impersonation", 15, r"\b(?:microsoft|apple|amazon|revenue agency|cra|irs|bank) (?:support|security|team)\b"),
)
BILLING = (
    Signal("auto_renewal", 25, r"\b(?:auto-?renew|automatically renew|renews on|will be charged)\b"),
    Signal("price_rise", 30, r"\b(?:price|rate|fee|subscription) (?:increase|change|adjustment|will (?:go up|rise))\b"),
    Signal("trial_conversion", 25, r"\b(?:free trial|trial period) (?:ends|ending|expires)\b"),
    Signal("penalty", 20, r"\b(?:cancel(?:lation)? fee|early termination|restocking fee)\b"),
    Signal("intro_rate", 25, r"\b(?:promotional|introductory) (?:rate|price|period) (?:ends|expires)\b"),
)
# How amounts and deadlines are written.
MONEY = r"[$£€]\s?\d[\d,]*(?:\.\d{2})?|\b\d[\d,]*(?:\.\d{2})?\s?(?:dollars|usd|cad|eur|gbp)\b"
DEADLINE = r"\b(?:by|before|due|expires?|deadline)\s+(?:\w+\s+\d{1,2}|\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?|\d{1,2}\s+\w+)"
# The scores of the verdicts, matches shown of each kind, and the letters of a body that stand for a subject.
LIKELY, SUSPICIOUS, WATCH, SHOWN, TOPIC_CHARS = 50, 25, 25, 5, 80

#: What each verdict asks of the owner, as a code.
ADVICE = {"likely_scam": "do_not_act", "suspicious": "verify_sender", "money_watch": "check_terms", "needs_decision": "decide", "routine": "none"}


def first_letters(regex: str) -> str | None:
    """The letters that a rule's matches begin with, if it is a group of alternatives that each begin with a letter, and what follows; else None."""
    begun = regex.removeprefix(r"\b").removesuffix(r"\b")
    if not begun.startswith("(?:") or re.search(r"[\\\[]|\((?!\?:)", begun):
        return None
    out, depth, due, closed = "", 0, False, False
    for i, c in enumerate(begun):
        if due:
            if not c.isalnum() or begun[i + 1 : i + 2] in ("?", "*", "{"):
                return None
            out, due = out + c, False
        if c == "(":
            depth += 1
        elif c == ":" and begun[i - 2 : i] == "(?":
            due = depth == 1 and not closed
        elif c == ")":
            depth -= 1
            if depth == 0 and not closed:
                closed = True
                if begun[i + 1 : i + 2] in ("?", "*", "{"):
                    return None
        elif c == "|":
            if depth == 0:
                return None
            due = depth == 1 and not closed
    return "".join(sorted(set(out)))


def flags(text: Column, signals: tuple[Signal, ...]) -> Column:
    """Names of the rules that fire, in order.

    At most places of a text the first letter alone rules a pattern out, where it has known ones; borders are dear to test at each.
    """

    def fires(t: Column, s: Signal) -> Column:
        first = first_letters(s.regex)
        whole = t.rlike("(?U)" + s.regex)
        return t.rlike(f"(?=[{first}])" + s.regex.replace(r"\b", "")) & whole if first else whole

    named = F.transform(F.array(text), lambda t: F.array_compact(F.array(*(F.when(fires(t, s), F.lit(s.name)) for s in signals))))
    return F.get(named, F.lit(0))


def weight(found: Column, signals: tuple[Signal, ...]) -> Column:
    weights = F.create_map(*(F.lit(x) for s in signals for x in (s.name, s.weight)))
    return F.least(F.aggregate(found, F.lit(0), lambda a, x: a + weights[x]), F.lit(100))


def first_matches(text: Column, regex: str) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit("(?iuU)" + regex), F.lit(0)), 1, SHOWN)


def amounts(text: Column) -> Column:
    return first_matches(text, MONEY)


def deadlines(text: Column) -> Column:
    return first_matches(text, DEADLINE)


def triage(messages: DataFrame, scam: tuple[Signal, ...] = SCAM, billing: tuple[Signal, ...] = BILLING) -> DataFrame:
    """messages (subject, body and more) with flags, scores, amounts, deadlines, verdict and advice. Nulls are empty."""
    text = F.concat(F.coalesce("subject", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    found = spread(messages).withColumn("text", text).withColumns({
        "scam_flags": flags(F.lower("text"), scam), "billing_flags": flags(F.lower("text"), billing), "money": amounts(F.col("text")), "deadlines": deadlines(F.col("text")),
    })
    scored = found.drop("text").withColumns({"scam_score": weight(F.col("scam_flags"), scam), "billing_score": weight(F.col("billing_flags"), billing)})
    verdict = (
        F.when(F.col("scam_score") >= LIKELY, "likely_scam").when(F.col("scam_score") >= SUSPICIOUS, "suspicious").when(F.col("billing_score") >= WATCH, "money_watch")
        .when((F.size("money") > 0) | (F.size("deadlines") > 0), "needs_decision").otherwise("routine")
    )
    advice = F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair))
    return scored.withColumn("verdict", verdict).withColumn("advice", advice[F.col("verdict")])


def topic_of(subject: Column, body: Column) -> Column:
    """The subject, unless it is empty (blank isn't), else how the body begins."""
    return F.when(F.coalesce(subject, F.lit("")) != "", subject).otherwise(F.left(F.coalesce(body, F.lit("")), F.lit(TOPIC_CHARS)))


def message_priorities(messages: DataFrame, priorities: DataFrame) -> DataFrame:
    """The owner's priorities that bear on each message (owner_id, msg_id, subject, body), ranked."""
    topics = messages.select("owner_id", F.col("msg_id").alias("topic_id"), topic_of(F.col("subject"), F.col("body")).alias("topic"))
    return basis_priorities(topics, priorities)
