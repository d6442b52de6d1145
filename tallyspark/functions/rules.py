"""Rule gate: ordered high-precision patterns that decide a message without a model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# --- fixed values: labels and rule patterns ------------------------------------------
INTENTS = ("refund request", "complaint", "order inquiry", "compliment", "spam")
URGENT_LABEL = "urgent escalation"
TRIAGE_LABELS = (*INTENTS, URGENT_LABEL)

# Each pattern begins with the first letters of all its branches: a place without them is passed over before a word boundary or a branch is tried.
SPAM_PATTERN = (
    r"(?=[cfgebs][roeua]|[\u0600-\u06FF])(?:"
    r"\b(?:crypto|forex|guaranteed returns?|earn money|buy followers|seo services?)\b"
    r"|(?:زيادة|شراء)\s+(?:متابعين|لايكات)"
    r"|(?:استثمار|فوركس|عملات رقمية).{0,30}(?:مضمون|ارباح|أرباح)"
    r"|خدمات\s+(?:سيو|تسويق).{0,30}(?:نقدم|نعرض)"
    r")"
)
ESCALATION_PATTERN = (
    r"(?=i[' ]|[lmc][eyo]|[\u0600-\u06FF])(?:"
    r"\b(?:i(?:'ll| will| am going to)\s+(?:sue|call (?:the )?police|report (?:you|this)"
    r"|post (?:this|it) (?:online|on social media))|legal action|my lawyer|consumer protection)\b"
    r"|(?:سوف|راح|حـ?ا|ه)?(?:أرفع|ارفع|أقدم|اقدم)\s+(?:قضية|بلاغ|شكوى)"
    r"|(?:هكلم|سأتواصل مع|سابلغ|سأبلغ|ابلغ)\s+(?:الشرطة|المحامي|حماية المستهلك|الوزارة)"
    r"|(?:هنشر|سأنشر|سوف أنشر|افضح|هفضح).{0,40}(?:السوشيال|فيسبوك|تويتر|انستجرام|الناس)"
    r")"
)
HARM_PATTERN = (
    r"(?=[fpawedlc][olnema]|[\u0600-\u06FF])(?:"
    r"\b(?:food poisoning|poisoned|allergic reaction|anaphylaxis|went to (?:the )?hospital"
    r"|emergency room|data breach|leaked my (?:personal )?data|card details exposed)\b"
    r"|(?:تسمم|اتسمم|تسممنا|حساسية|اختناق).{0,45}(?:بعد|بسبب|من الأكل|من الطلب)"
    r"|(?:روحنا|ذهبت|رحت).{0,15}(?:المستشفى|الطوارئ)"
    r"|(?:سربتم|تسريب|انكشفت).{0,30}(?:بياناتي|بيانات شخصية|بطاقتي)"
    r")"
)
REFUND_PATTERN = (
    r"(?=[rmc][eoh]|[\u0600-\u06FF])(?:"
    r"\b(?:refund|money back|chargeback)\b|(?:استرجاع|استرداد|رجعوا|رجعولي).{0,20}(?:فلوس|المبلغ)?"
    r")"
)
# ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``intent`` None means: refund request if the refund pattern also matches, else complaint."""

    rule_id: str
    pattern: str
    urgent: bool
    intent: str | None = None


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    refund_pattern: str
    version: str


DEFAULT_RULES = RuleSet(
    (
        Rule("spam_unsolicited_solicitation_v1", SPAM_PATTERN, False, "spam"),
        Rule("urgent_explicit_escalation_v1", ESCALATION_PATTERN, True),
        Rule("urgent_credible_harm_v1", HARM_PATTERN, True),
    ),
    REFUND_PATTERN,
    "rules-v1",
)


def _found(text: Column, pattern: str) -> Column:
    # i: ignore case, u: also beyond ASCII, U: Unicode \b, \s and \w, d: only a line feed ends a line.
    return text.rlike(f"(?iduU){pattern}")


def rule_gate(text: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """struct(intent, is_urgent, rule_id) of the first rule that matches, else null."""
    decision = None
    for rule in rules.rules:
        intent = (
            F.lit(rule.intent) if rule.intent
            else F.when(_found(text, rules.refund_pattern), "refund request").otherwise("complaint")
        )
        made = F.struct(
            intent.alias("intent"), F.lit(rule.urgent).alias("is_urgent"), F.lit(rule.rule_id).alias("rule_id")
        )
        hit = _found(text, rule.pattern)
        decision = F.when(hit, made) if decision is None else decision.when(hit, made)
    return decision


def triage_label(intent: Column, is_urgent: Column) -> Column:
    """Urgency wins over intent."""
    return F.when(is_urgent, F.lit(URGENT_LABEL)).otherwise(intent)
