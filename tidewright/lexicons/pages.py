"""What tells the kind of a page, and what stands before a keyword that negates or compares it. All entries are fixed values, in their natural order."""

#: Patterns that tell the kind of a page, with whether letter case is ignored and whether ^ and $ mean lines.
PAGE_PATTERNS = {
    "blog": [(r"\b(?:posted|published)\s+(?:on|at)\s+", "i"), (r"\bby\s+[A-Z][a-z]+\s+[A-Z][a-z]+", ""), (r"\b\d+\s+(?:min|minute)s?\s+read\b", "i"),
             (r"\b(?:comments?|replies|responses)\s*(?:\(\d+\)|\[\d+\])?\s*$", "im"), (r"\btags?:\s*", "i"), (r"\bcategory:\s*", "i"), (r"\bshare\s+(?:this|on)\s+", "i")],
    "product": [(r"\badd\s+to\s+(?:cart|bag|basket)\b", "i"), (r"\bbuy\s+(?:now|it|this)\b", "i"), (r"\b(?:quantity|qty)[:\s]+", "i"), (r"\bsize[:\s]+", "i"), (r"\bcolor[:\s]+", "i"),
                (r"\brating[:\s]+[\d.]+", "i"), (r"\b\d+\s+reviews?\b", "i"), (r"\bfree\s+shipping\b", "i")],
    "landing": [(r"\bget\s+started\b", "i"), (r"\bsign\s+up\b", "i"), (r"\bstart\s+(?:your\s+)?free\s+trial\b", "i"), (r"\brequest\s+(?:a\s+)?demo\b", "i"), (r"\bcontact\s+(?:us|sales)\b", "i"),
                (r"\bschedule\s+(?:a\s+)?(?:call|meeting)\b", "i")],
    "faq": [(r"^Q:\s*", "m"), (r"^A:\s*", "m"), (r"\bfrequently\s+asked\s+questions?\b", "i"), (r"\bfaq\b", "i"), (r"\?\s*\n+[A-Z]", "")],
    "howto": [(r"\bstep\s+\d+[:.]", "i"), (r"\bhow\s+to\s+\w+", "i"), (r"^\d+\.\s+\w+.*\n\d+\.\s+\w+", "m"), (r"\b(?:first|second|third|finally)[,:]?\s+", "i")],
}

NEGATIONS = [
    r"\bnot\s+(?:a|an|the)?\s*", r"\bno\s+", r"\bnever\s+", r"\bwithout\s+(?:a|an|the)?\s*", r"\bisn't\s+(?:a|an|the)?\s*", r"\baren't\s+", r"\bwasn't\s+", r"\bweren't\s+", r"\bdon't\s+",
    r"\bdoesn't\s+", r"\bdidn't\s+", r"\bwon't\s+", r"\bcan't\s+", r"\bcannot\s+", r"\bunlike\s+", r"\brather\s+than\s+", r"\binstead\s+of\s+",
]
COMPARISONS = [
    r"\bcompared\s+to\s+", r"\bsimilar\s+to\s+", r"\blike\s+(?:a|an|other)?\s*", r"\bsuch\s+as\s+", r"\bfor\s+example\s*", r"\be\.g\.\s*", r"\bi\.e\.\s*", r"\bversus\s+", r"\bvs\.?\s+",
    r"\babout\s+", r"\bdiscussing\s+", r"\btalking\s+about\s+", r"\bmentioning\s+",
]
