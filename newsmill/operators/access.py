"""What kind of access a page grants, by signals in its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import sentence_ends

#: Signals (fixed values), by kind.
CALLS = [
    r"subscribe\s+to\s+(?:continue\s+reading|continue|read|unlock|access|view)", r"(?:sign\s*in|log\s*in|login)\s+to\s+(?:continue\s+reading|continue|read|access|unlock|view)",
    r"(?:you\s+must|please)\s+(?:sign\s*in|log\s*in|subscribe|register)\s+to\s+(?:continue|read|access|unlock|view)", r"become\s+a\s+(?:subscriber|member)\s+to\s+(?:continue|read|unlock|access|view)",
    r"(?:this|the)\s+(?:article|story|content)\s+is\s+(?:for|available\s+to|exclusive\s+to)\s+(?:subscribers|members)", r"(?:subscriber|member)[\s-]+only\s+(?:article|story|content|access|reading|section)",
    r"(?:unlock|access)\s+(?:this|the|full)\s+(?:article|story|content)", r"(?:read|view)\s+(?:the\s+)?(?:full|complete|rest\s+of)\s+(?:this\s+)?(?:article|story|content)\s+(?:by|after)\s+(?:subscribing|signing\s*in)",
]
CHALLENGES = [
    r"checking\s+your\s+browser", r"verify(?:ing)?\s+(?:you\s+are|that\s+you\s+are)\s+(?:human|not\s+a\s+robot)", r"are\s+you\s+a\s+robot", r"\bcaptcha\b", r"robot\s+(?:challenge|check|verification)", r"attention\s+required",
    r"please\s+wait\s+(?:while|for|a\s+moment)", r"you\s+will\s+(?:be\s+)?redirected", r"redirecting\s+(?:you|your\s+request)", r"(?:request|page)\s+(?:is\s+)?(?:processing|in\s+queue)", r"powered\s+by\s+(?:cloudflare|incapsula|imperva)",
    r"enable\s+javascript\s+to\s+(?:continue|read|view|access)", r"javascript\s+(?:is\s+)?disabled", r"one\s+moment\s*(?:please)?", r"just\s+a\s+moment", r"page\s+is\s+loading", r"before\s+(?:accessing|proceeding|continuing)",
]
DENIALS = [r"\baccess\s+denied\b", r"\baccess\s+forbidden\b", r"\brequest\s+denied\b", r"you\s+don'?t\s+have\s+permission", r"403\s+forbidden"]
AD_BLOCKERS = [r"please\s+disable\s+your\s+ad\s*blocker", r"ad\s*block(?:er)?\s+detected", r"you\s+are\s+using\s+an?\s+ad\s*blocker"]
#: Words that a page about subscriptions has as well; they never decide (fixed values).
TOPICS = [r"paywall", r"\bsubscription\b", r"\bsubscriber[s]?\b", r"\bpremium\b", r"\bnewsletter\b"]
#: Statuses that block, and characters and sentences of a text that is an article (fixed values).
BLOCKED, SUBSTANTIAL, SENTENCES = [401, 403], 400, 3
#: Signals that scripts or cookies are off (fixed values, English and Hungarian).
INTERSTITIAL = {
    "javascript_disabled": [r"javascript(?:\s+is)?\s+disabled", r"enable\s+javascript", r"le\s+van\s+tiltva\s+a\s+javascript", r"engedélyezd\s+a\s+javascript\s+futását"],
    "cookies_disabled": [r"cookies?\s+(?:are|is)\s+disabled", r"enable\s+(?:the\s+)?cookies?", r"le\s+van\s+tiltva\s+a\s+sütik?\s+használata", r"engedélyezd\s+a\s+sütik?\s+használatát"],
}
#: Least characters of a body that may be published (fixed value).
PUBLISHABLE = 500
KINDS = {"call": CALLS, "challenge": CHALLENGES, "denial": DENIALS, "ad_blocker": AD_BLOCKERS}


def signal(text: Column, kind: str) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(f"(?:{p})" for p in KINDS[kind]))


def is_substantial(text: Column) -> Column:
    t = F.trim(text)
    return F.coalesce((F.length(t) >= SUBSTANTIAL) & (sentence_ends(t) >= SENTENCES), F.lit(False))


def _matches(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns a text has."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.when(t.rlike(p), 1).otherwise(0) for p in patterns[1:]), F.when(t.rlike(patterns[0]), 1).otherwise(0))


def access_decision(status: Column, raw: Column, usable: Column, truncated: Column, gate: Column, calls: Column, declared: Column, matched: Column) -> Column:
    """struct(class, confidence, evidence) of a page, first of nine steps: a blocking status; without a usable body a
    challenge, a denial, or a call to subscribe; declared in structured data; with a usable body a call, a gate, or
    nothing against it; an ad blocker's warning; a gate; nothing decides.

    ``raw`` the page's text; ``usable``, ``truncated``, ``gate`` what extraction saw; ``calls`` the article's own calls
    to subscribe (a text); ``declared`` whether structured data declare a wall, ``matched`` whether they do it for this
    very article.  Nulls are false.
    """
    no = lambda x: F.coalesce(x, F.lit(False))
    usable, truncated, gate, declared, matched = map(no, (usable, truncated, gate, declared, matched))
    challenge, call, denial, topic = _matches(raw, CHALLENGES), signal(calls, "call"), signal(raw, "denial"), signal_of(raw, TOPICS)

    def told(kind: str, sure: str | Column, *codes: Column | str) -> Column:
        evidence = F.array_compact(F.array(*[F.lit(x) if isinstance(x, str) else x for x in codes], F.when(topic, "topic_signals")))
        return F.struct(F.lit(kind).alias("class"), (F.lit(sure) if isinstance(sure, str) else sure).alias("confidence"), evidence.alias("evidence"))

    gated, cut = F.when(gate, "article_scoped_gate_or_overlay"), F.when(truncated, "body_truncation_detected")
    sure = lambda x, a, b: F.when(x, a).otherwise(b)
    return (
        F.when(no(status.isin(BLOCKED)), F.struct(F.lit("HTTP_ACCESS_BLOCKED").alias("class"), F.lit("HIGH").alias("confidence"), F.array(F.lit("http_status_blocked")).alias("evidence")))
        .when(~usable & (challenge > 0), told("INTERSTITIAL_OR_CHALLENGE", sure(challenge >= 2, "MEDIUM", "LOW"), "interstitial_challenge", F.when(denial, "http_denied_text")))
        .when(~usable & denial, told("HTTP_ACCESS_BLOCKED", "MEDIUM", "http_denied_text"))
        .when(~usable & call, told("PAYWALL_BLOCKED", sure(gate | truncated, "HIGH", "MEDIUM"), "article_scoped_cta", gated, cut))
        .when(declared, told("METERED_OR_DECLARED", F.when(gate & usable, "HIGH").when(matched, "MEDIUM").otherwise("LOW"), "jsonld_declared_paywall", F.when(gate & usable, "article_scoped_gate_or_overlay")))
        .when(usable & call, told("METERED_OR_DECLARED", sure(gate, "HIGH", "MEDIUM"), "article_scoped_cta", gated))
        .when(usable & gate, told("METERED_OR_DECLARED", "LOW", "article_scoped_gate_or_overlay"))
        .when(usable, F.struct(F.lit("ACCESSIBLE").alias("class"), F.lit("HIGH").alias("confidence"), F.array(F.lit("usable_full_body_extracted")).alias("evidence")))
        .when(signal(raw, "ad_blocker"), told("INTERSTITIAL_OR_CHALLENGE", "LOW", "ad_blocker_warning"))
        .when(gate, told("PAYWALL_BLOCKED", "LOW", "article_scoped_gate_or_overlay"))
        .otherwise(told("UNKNOWN", "LOW", F.when(F.trim(F.coalesce(raw, F.lit(""))) != "", "partial_body_without_evidence")))
    )


def signal_of(text: Column, patterns: list[str]) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(f"(?:{p})" for p in patterns))


def access_hint(status: Column, text: Column, declared: Column | None = None) -> Column:
    """access_decision() where only a text is known: a substantial one is the article, a shorter one may be a call."""
    full, no = is_substantial(text), F.lit(False)
    return access_decision(status, text, full, no, no, F.when(~full, text), no if declared is None else declared, no)


def access_class(status: Column, text: Column) -> Column:
    return access_hint(status, text)["class"]


def interstitial_signals(text: Column) -> Column:
    """The codes of the signals that scripts or cookies are off."""
    return F.array_compact(F.array(*[F.when(signal_of(text, p), F.lit(k)) for k, p in INTERSTITIAL.items()]))


def is_usable(body: Column) -> Column:
    """A body of at least PUBLISHABLE characters that isn't a page about both scripts and cookies."""
    blocked = F.size(interstitial_signals(body)) == len(INTERSTITIAL)
    return F.coalesce((F.length(F.trim(body)) >= PUBLISHABLE) & ~blocked, F.lit(False))


def is_publishable(title: Column, url: Column, body: Column) -> Column:
    some = lambda x: F.coalesce(F.trim(x), F.lit("")) != ""
    return some(title) & some(url) & is_usable(body)


def is_paywall(kind: Column) -> Column:
    """True, false or unknown; what is metered or only declared can be read."""
    return F.when(kind == "PAYWALL_BLOCKED", True).when(kind.isin("ACCESSIBLE", "METERED_OR_DECLARED"), False)
