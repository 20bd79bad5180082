"""Word lists of scoring and filtering. All are parameters; these are the defaults (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass, field

STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on",
    "or", "that", "the", "their", "this", "to", "was", "were", "with",
)
INTENT_STOPWORDS = ("summarize", "summary", "simple", "simply", "explain", "explanation", "terms", "overview", "describe", "discuss", "research", "work", "paper", "papers")
FACET_STOPWORDS = ("already", "directly", "establish", "establishes", "evidence", "mature", "paper", "papers", "research", "review", "shows", "source", "study", "substantial")
ANSWER_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "did", "do", "does", "for", "from", "how", "in", "into", "is", "it", "its", "of", "on", "or", "say", "says",
    "that", "the", "their", "them", "these", "this", "to", "was", "were", "what", "when", "where", "which", "who", "why", "with",
)
KEYWORD_STOPWORDS = ("study", "results", "discussion", "introduction", "conclusion", "conclusions", "paper", "method", "methods", "analysis", "data", "article", "research", "using", "used", "model")
QUESTION_WORDS = (
    "what", "which", "when", "where", "who", "whom", "whose", "why", "how", "did", "does", "do", "the", "a", "an", "in", "on", "for", "of", "to", "about", "argue", "says", "say",
)
REWRITE_GENERIC = ("archaeology", "archaeological", "article", "evidence", "paper", "papers", "research", "study", "studies", "summary", "overview", "method", "methods")
REFERENCE_HEADINGS = ("references", "bibliography", "works cited", "literature cited")
DOMAIN_TERMS = (
    "hohokam", "anasazi", "mogollon", "fremont", "arizona", "utah", "sonoran", "southwestern", "projectile", "point", "points",
    "arrowhead", "arrowheads", "dart", "darts", "lithic", "typology", "typological", "ceramic", "pottery",
)
ANCHOR_TERMS = ("hohokam", "anasazi", "mogollon", "fremont", "arizona", "utah", "sonoran", "southwestern")
GENERIC_MUST_TERMS = ("projectile", "point", "points", "ceramic", "pottery", "lithic", "typology", "typological")
REVIEW_CONTRADICTIONS = ("human review", "expert review", "expert human review", "requires human review", "remain complementary to expert human review", "complementary to expert human review")
CLAIM_STRENGTH = ("directly establishes", "direct support", "solved")
HEDGES = ("limitations", "limited", "cautious", "future directions", "requires", "remain complementary")
FAMILIES = {
    "culture": ("hohokam", "anasazi", "mogollon", "fremont"),
    "place": ("arizona", "utah", "mexico", "southwestern", "sonoran", "four", "corners"),
    "artifact": (
        "projectile", "point", "points", "arrowhead", "arrowheads", "dart", "darts", "lithic", "biface", "bifaces", "typology", "typological", "ceramic", "pottery",
        "wares", "sherd", "sherds", "types", "pithouse", "architecture", "household", "settlement",
    ),
}


@dataclass(frozen=True)
class Vocabulary:
    """The domain's words."""

    domain: tuple[str, ...] = DOMAIN_TERMS
    anchors: tuple[str, ...] = ANCHOR_TERMS
    generic: tuple[str, ...] = GENERIC_MUST_TERMS
    families: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(FAMILIES))
