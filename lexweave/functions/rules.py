"""Fixed values of the domain rules: word lists, patterns, texts and limits that decide results.

Patterns are written with Unicode classes in mind; spark() and re2() give each engine its dialect.
"""

from __future__ import annotations

# ---- fixed values -------------------------------------------------------------------------------------

EXPANSIONS = (
    (r"срок|дата", "deadline due date"),
    (r"бюджет|цен", "budget contract price"),
    (r"штраф|неустойк|пен[ияи]", "penalty fine liquidated damages"),
    (r"требован", "requirements eligibility"),
    (r"поставщик|участник", "supplier bidder"),
    (r"документ", "documents evidence certificate"),
    (r"опыт|проект", "experience completed projects"),
    (r"оплат", "payment"),
    (r"исполнен|контракт", "contract duration performance"),
    (r"гаранти", "warranty"),
)

TOKEN = "[A-Za-zА-Яа-яЁё0-9]+"
LEXICAL_STOP = ("a", "an", "does", "is", "the", "what", "when", "which", "в", "где", "для", "до", "как", "какая", "какие", "каков", "какова", "какой", "когда", "на", "у", "что")
QA_STOP = ("какой", "какая", "какие", "что", "где", "когда", "должен", "the", "what", "which", "when", "where", "does", "document")

#: (question pattern, evidence pattern); the first question pattern that matches decides.
INTENTS = (
    (
        r"начальн\w+.*цен|предельн\w+\s+бюджет|сумм\w+.*предлож|maximum contract value|budget cap|offer not exceed",
        r"(?:начальн\w+.*цен|предельн\w+\s+бюджет|цен\w+\s+предлож|maximum (?:contract )?value|procurement budget|financial offer)"
        r".{0,260}(?:(?:руб|₽|RUB|USD|EUR|GBP)\s*\d[\d\s.,]*|\d[\d\s.,]*\s*(?:руб|₽|RUB|USD|EUR|GBP))",
    ),
    (
        r"прием\w*\s+заяв|подат\w*\s+(?:заяв|предлож)|дедлайн.*подач|proposal deadline|bid.*submit|submission cutoff",
        r"(?:прием\w*\s+заяв|срок\w*\s+подач|направ\w+\s+заявк|proposal deadline|proposals? must be received|submit.*offer no later)"
        r".{0,260}(?:\d{1,2}[:.]\d{2}|\d{1,2}\s+[A-Za-zА-Яа-яЁё]+\s+20\d{2})",
    ),
)

DATE_VALUE = (
    r"(?:\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b|"
    r"\b\d{1,2}\s+(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{4}\b|"
    r"\b\d{1,2}\s+(?:января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря)\s+\d{4}\b)"
)
MONEY_VALUE = r"\b\d[\d\s.,]*\s*(?:₽|руб(?:\.|лей|ля|ль)?|RUB|USD|EUR|доллар(?:ов|а)?|евро)\b"
PENALTY_VALUE = r"(?:\b\d+(?:[.,]\d+)?\s*%|\b\d[\d\s.,]*\s*(?:₽|руб(?:\.|лей|ля|ль)?|RUB|USD|EUR)\b)"

#: (category, queries, keyword pattern, value pattern, value required), in the order of categories.
CONDITIONS = (
    (
        "deadline",
        ("submission deadline due date", "срок подачи дата окончания"),
        r"(?:deadline|due\s+date|submission\s+date|срок(?:и|а|ом)?\s+(?:подачи|предоставления|окончания)|дата\s+(?:подачи|окончания))",
        DATE_VALUE,
        False,
    ),
    (
        "budget",
        ("maximum budget contract price", "бюджет начальная максимальная цена"),
        r"(?:maximum\s+budget|budget|contract\s+(?:price|value)|бюджет|начальн\w*\s+максимальн\w*\s+цен\w*|нмцк|цена\s+контракта)",
        MONEY_VALUE,
        True,
    ),
    (
        "penalty",
        ("penalty fine liquidated damages", "штраф пени неустойка"),
        r"(?:penalt(?:y|ies)|fine|liquidated\s+damages|штраф\w*|пен(?:я|и|ей)|неустойк\w*)",
        PENALTY_VALUE,
        False,
    ),
    (
        "requirement",
        ("bidder supplier eligibility requirements", "требования к участнику поставщику"),
        r"(?:eligibility|qualification|requirement|bidder\s+(?:must|shall)|supplier\s+(?:must|shall)|требован\w*|(?:участник|поставщик)\s+(?:должен|обязан))",
        None,
        False,
    ),
)
MAX_ITEMS = 5

#: (category, rule, severity, title, description, recommendation), in checklist order.
RISKS = (
    ("deadline", "deadline_compliance", "high", "Deadline compliance", "The document contains a submission or delivery deadline.", "Confirm the timezone, submission channel, and an earlier internal cutoff."),
    ("budget", "budget_fit", "medium", "Budget fit", "The document contains a budget or contract value condition.", "Validate taxes, currency, included costs, and commercial feasibility."),
    ("penalty", "penalty_exposure", "high", "Penalty exposure", "The document contains a penalty, fine, or liquidated damages condition.", "Quantify the maximum exposure and review triggering events manually."),
    ("requirement", "eligibility_evidence", "high", "Eligibility evidence", "The document contains bidder or supplier requirements.", "Map every requirement to an owner and supporting document before submission."),
)
MISSING_TITLE = "{} not found"
MISSING_DESCRIPTION = "Automatic analysis did not find an explicit {} condition."
MISSING_RECOMMENDATION = "Review the original PDF manually before making a decision."

#: (category, question pattern, evidence pattern); the first question pattern that matches names the category.
QUESTIONS = (
    ("insurance", r"страхов|полис|insurance|policy", r"страхов|полис|insurance|policy"),
    ("subcontracting", r"субподряд|subcontract", r"субподряд|subcontract"),
    (
        "performance_security",
        r"обеспеч\w*\s+(?:надлежащ\w+\s+)?исполн|гарант\w+\s+исполн|победител\w+.*обеспеч|performance security|contract security|security.*proper performance",
        r"обеспеч\w*.*исполн|победител\w+.*обеспеч|performance security|security.*contract performance|successful bidder.*security",
    ),
    (
        "bid_security",
        r"обеспеч\w*.*заяв|внести.*участи|обеспеч\w*.*подач|bid security|security.*participat|security.*bid",
        r"обеспеч\w*\s+заяв|для участи\w+.*обеспеч|bid security|participation requires.*security|bidder.*lodge.*security",
    ),
    (
        "deadline",
        r"прием\w*\s+заяв|подат\w*\s+(?:заяв|предлож)|дедлайн.*подач|proposal deadline|bid.*submit|submission cutoff",
        r"прием\w*\s+заяв|последн\w+\s+срок\w*\s+подач|направ\w+\s+заявк\w+\s+не позднее|заявк\w+.*отклон|"
        r"proposals? must be received|proposal submission deadline is|submit.*offer no later|late (?:bid|submission)",
    ),
    (
        "budget",
        r"начальн\w+.*цен|предельн\w+\s+бюджет|сумм\w+.*предлож|maximum contract value|budget cap|offer not exceed",
        r"начальн\w+\s+(?:максимальн\w+\s+)?цен\w+\s+контракт|предельн\w+\s+бюджет|цен\w+\s+предлож|maximum contract value\s+(?:is|equals)|procurement budget|offer must not exceed",
    ),
    ("payment", r"оплат|оплач|расчет|перечисл|payment|customer pay|receive payment", r"оплат|расчет\w*.*исполнител|перечисл|payment|customer pays|receive payment"),
    ("penalty", r"пен[яеи]|неустой|штраф|просроч|задерж|penalty|liquidated damages|delay", r"пен[яеи]|неустой|штраф|просроч|задерж|penalty|liquidated damages|delay"),
    ("warranty", r"гарантийн\w+\s+срок|гаранти\w+.*после прием|warranty", r"гарантийн\w+\s+срок|предоставл\w+\s+гаранти|warranty"),
    (
        "delivery",
        r"срок\w*[ \t]+исполнени\w*|\bзаверш\w+.*(?:постав|работ)|выполн\w+\s+обязатель|delivery period|delivery.*completed|allowed for performance",
        r"срок\w*[ \t]+исполнени\w*|постав\w+.*\bзаверш|\bзаверш\w+.*работ|delivery.*completed|required performance period|complete.*scope",
    ),
)
QUOTE_VALUE = r"\d+(?:[.,]\d+)?\s*(?:%|руб|дн|дней|дня|месяц|час|usd|eur|gbp|business days?|calendar days?|months?)"
PERCENT_QUESTION = r"процент|percentage|%"
PERCENT_VALUE = r"\d+(?:[.,]\d+)?\s*%"
NUMBER_QUESTION = r"номер|number"
POLICY_NUMBER = r"(?:полис|policy).{0,80}(?:номер|number|N|№|:)\s*[A-ZА-Я0-9][A-ZА-Я0-9-]{2,}"
QUOTE_LIMIT = 800
REFUSALS = {
    "ru": "В найденных фрагментах документа недостаточно данных для точного ответа.",
    "en": "The retrieved document fragments do not contain enough evidence for a precise answer.",
}

#: By category of a tender fact those that are taken for it most easily: the preferred hard negatives.
CONFUSIONS = {
    "deadline": ("delivery", "payment", "warranty"),
    "budget": ("bid_security", "performance_security", "penalty"),
    "delivery": ("deadline", "warranty", "payment"),
    "payment": ("delivery", "deadline", "budget"),
    "bid_security": ("performance_security", "penalty", "budget"),
    "performance_security": ("bid_security", "penalty", "budget"),
    "penalty": ("bid_security", "performance_security", "payment"),
    "warranty": ("delivery", "payment", "deadline"),
}
FACT_KINDS = tuple(CONFUSIONS)

CHUNK_SIZE, CHUNK_OVERLAP, LEAST_SHARE = 1600, 200, 0.6
DENSE_K, LEXICAL_K, FINAL_K, RRF_K = 20, 20, 5, 60
EVIDENCE_LIMIT, MAX_CLAIMS, ANALYSIS_LIMIT = 8, 5, 8
HIGHLIGHT_CLASS, LEAST_FRAGMENT = "pdf-citation-highlight", 6
MAX_UPLOAD_BYTES = 20 * 1024 * 1024

# ---- end of fixed values ------------------------------------------------------------------------------


def spark(pattern: str, fold: bool = True, dotall: bool = False) -> str:
    """For Java: Unicode classes and line feeds only, as the rules mean them."""
    return f"(?Ud{'iu' * fold}{'s' * dotall}){pattern}"


def re2(pattern: str, fold: bool = True, dotall: bool = False) -> str:
    """For DuckDB, as an SQL literal."""
    flags = "i" * fold + "s" * dotall
    body = pattern.replace(r"\w", r"[\p{L}\p{N}_]")
    return "'" + (f"(?{flags})" if flags else "") + body.replace("'", "''") + "'"
