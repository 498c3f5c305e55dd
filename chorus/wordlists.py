"""Word lists the operators work with. All can be replaced by parameters."""

from __future__ import annotations

import unicodedata

# Keywords whose presence explains a sentiment class.
POSITIVE_KEYWORDS = (
    "good", "great", "excellent", "amazing", "wonderful", "best", "love",
    "happy", "hope", "improve", "growth", "opportunity", "success", "better",
)
NEGATIVE_KEYWORDS = (
    "bad", "worst", "terrible", "poor", "hate", "problem", "issue", "crisis",
    "unemployment", "jobless", "difficult", "hard", "struggle", "fail", "corrupt",
)
NEUTRAL_KEYWORDS = (
    "okay", "fine", "average", "normal", "same", "usual", "just", "only",
    "data", "report", "statistics", "number", "rate", "percent",
)
CLASS_KEYWORDS = {
    "Positive": POSITIVE_KEYWORDS, "Negative": NEGATIVE_KEYWORDS, "Neutral": NEUTRAL_KEYWORDS,
}

# Search phrases per collection category.
EMPLOYMENT_KEYWORDS = (
    "jobs in india", "job openings india", "hiring india", "recruitment india",
    "job vacancies india", "careers india", "employment opportunities india",
    "job fair india", "walk in interview india", "job openings 2024",
    "IT jobs india", "software engineer jobs", "developer jobs india",
    "tech jobs india", "programming jobs", "data science jobs india",
    "AI jobs india", "machine learning jobs", "cybersecurity jobs india",
    "web developer jobs", "app developer jobs", "cloud jobs india",
    "bank jobs india", "finance jobs india", "accounting jobs",
    "chartered accountant jobs", "banking sector jobs", "investment banking jobs",
    "financial analyst jobs", "audit jobs india", "insurance jobs india",
    "sarkari naukri", "government jobs india", "PSU jobs india",
    "UPSC jobs", "SSC jobs", "railway jobs india", "defense jobs india",
    "civil services jobs", "bank PO jobs", "government recruitment",
    "medical jobs india", "doctor jobs", "nursing jobs india",
    "pharma jobs india", "healthcare jobs", "hospital jobs india",
    "physiotherapy jobs", "lab technician jobs", "medical representative jobs",
    "engineering jobs india", "mechanical engineer jobs", "civil engineer jobs",
    "electrical engineer jobs", "automobile engineer jobs", "construction jobs india",
    "project engineer jobs", "quality engineer jobs", "production engineer jobs",
    "MBA jobs india", "management jobs", "business analyst jobs",
    "marketing jobs india", "sales jobs india", "HR jobs india",
    "operations manager jobs", "business development jobs", "consultant jobs india",
    "teaching jobs india", "professor jobs", "lecturer jobs india",
    "tutor jobs india", "education jobs", "school jobs india",
    "online teaching jobs", "coaching jobs india",
    "fresher jobs india", "entry level jobs india", "graduate jobs india",
    "experienced jobs india", "senior jobs india", "manager jobs india",
    "executive jobs india", "internship india", "trainee jobs india",
    "remote jobs india", "work from home jobs", "part time jobs india",
    "full time jobs india", "freelance jobs india", "contract jobs india",
    "permanent jobs india", "flexible jobs india",
    "job search india", "career guidance india", "how to get job india",
    "job interview tips india", "resume tips india", "career advice india",
    "job hunting india", "career growth india", "job switch india",
    "skill development india", "job training india", "upskilling india",
    "reskilling india", "certification jobs india", "professional courses india",
    "vocational training india", "job ready skills",
    "startup jobs india", "MNC jobs india", "top companies hiring india",
    "tech companies hiring", "best companies to work india", "unicorn jobs india",
    "jobs in bangalore", "jobs in mumbai", "jobs in delhi", "jobs in hyderabad",
    "jobs in pune", "jobs in chennai", "jobs in kolkata", "jobs in gurgaon",
    "latest jobs india", "new job openings", "jobs this week india",
    "jobs today india", "upcoming jobs india", "job notifications india",
)
UNEMPLOYMENT_KEYWORDS = (
    "unemployment india", "jobless india", "berozgaari", "job crisis india",
    "no jobs india", "employment crisis", "youth unemployment india",
    "layoffs india", "job loss india", "IT layoffs india", "tech layoffs india",
    "mass layoffs", "retrenchment india", "fired india", "pink slip india",
    "job market india", "job search india", "can't find job india",
    "placement crisis", "campus placement india", "fresher jobs india",
    "engineering unemployment", "MBA jobless", "graduate unemployment",
    "IIT unemployment", "educated unemployed india", "degree no job india",
    "salary cuts india", "job insecurity india", "gig economy india",
    "contract jobs india", "temporary jobs india",
    "unemployment depression", "jobless stress india", "unemployment anxiety",
    "career crisis india", "hopeless job search",
    "IT jobs crisis", "startup layoffs india", "manufacturing jobs india",
    "service sector jobs", "retail jobs crisis",
    "unemployment rate india", "CMIE unemployment", "jobs data india",
    "employment policy india", "rozgar yojana", "skill india program",
    "brain drain india", "migration for jobs", "reverse migration india",
    "rural unemployment", "urban unemployment india",
    "AI job loss india", "automation unemployment", "future of jobs india",
    "job displacement india", "skills gap india",
)
CATEGORY_KEYWORDS = {
    "employment": EMPLOYMENT_KEYWORDS, "unemployment": UNEMPLOYMENT_KEYWORDS,
}

# English function words left out of the features; pass your own for another list.
STOP_WORDS = (
    "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because",
    "been", "before", "being", "but", "by", "can", "could", "did", "do", "does", "down", "each",
    "few", "for", "from", "further", "had", "has", "have", "having", "he", "her", "here", "him",
    "his", "how", "if", "in", "into", "is", "it", "its", "may", "me", "more", "most", "must",
    "my", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our",
    "out", "over", "own", "same", "she", "should", "so", "some", "such", "than", "that", "the",
    "their", "them", "then", "there", "these", "they", "this", "those", "through", "to", "too",
    "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which",
    "while", "who", "whom", "why", "will", "with", "would", "you", "your",
)

CURLY_QUOTES = "“”‘’"
STRAIGHT_QUOTES = "\"\"''"


#: Code blocks of pictographic signs, as in the pattern that removes them.
EMOJI_BLOCKS = ((0x2600, 0x27BF), (0x1F300, 0x1FAFF))


def _named(*blocks: tuple[int, int]) -> dict[str, str]:
    """Signs of code blocks with names formed from their Unicode names."""
    signs = (chr(c) for first, last in blocks for c in range(first, last + 1))
    return {c: ":" + unicodedata.name(c).lower().replace(" ", "_") + ":"
            for c in signs if unicodedata.name(c, "")}


EMOJI_NAMES = _named(*EMOJI_BLOCKS)

# Words that turn, strengthen or weaken the sentiment of the words after them.
NEGATIONS = (
    "ain", "aren", "cannot", "couldn", "daren", "didn", "doesn", "don", "dont", "hadn", "hasn",
    "haven", "isn", "mightn", "mustn", "needn", "neither", "never", "no", "nobody", "none", "nope",
    "nor", "not", "nothing", "nowhere", "oughtn", "rarely", "seldom", "shan", "shouldn", "wasn",
    "weren", "without", "won", "wouldn",
)
BOOSTERS = (
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply",
    "enormously", "entirely", "especially", "exceptionally", "extremely", "fully", "greatly",
    "highly", "hugely", "incredibly", "intensely", "majorly", "more", "most", "particularly",
    "purely", "quite", "really", "remarkably", "so", "substantially", "thoroughly", "totally",
    "tremendously", "unbelievably", "unusually", "utterly", "very",
)
DAMPENERS = (
    "almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally", "partly",
    "scarcely", "slightly", "somewhat", "sorta",
)
