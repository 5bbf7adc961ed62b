"""Signs of what a page is about. All entries are fixed values, in their natural order; i ignores letter case, m lets ^ and $ mean lines."""

#: Type: keywords, patterns.
SIGNS = {
    "Product": (["price", "buy", "add to cart", "product", "sku", "in stock", "out of stock", "shipping"],
                [(r"\$[\d,]+(?:\.\d{2})?", ""), (r"(?:buy|purchase|order)\s+now", "i"), (r"add\s+to\s+cart", "i"), (r"(?:in|out\s+of)\s+stock", "i")]),
    "Article": (["author", "published", "article", "blog", "post", "written by", "read time"],
                [(r"(?:published|posted)\s+(?:on\s+)?(?:\w+\s+\d+,?\s+\d{4}|\d{4}-\d{2}-\d{2})", "i"), (r"by\s+[A-Z][a-z]+\s+[A-Z][a-z]+", ""), (r"\d+\s+min(?:ute)?s?\s+read", "i")]),
    "Organization": (["company", "about us", "our team", "founded", "headquarters", "employees", "mission"],
                     [(r"founded\s+(?:in\s+)?\d{4}", "i"), (r"(?:our|the)\s+(?:company|organization|team)", "i"), (r"headquarters?\s+(?:in|at)", "i")]),
    "Person": (["biography", "profile", "about me", "experience", "skills", "contact me"],
               [(r"(?:my|his|her)\s+(?:experience|background|career)", "i"), (r"years?\s+of\s+experience", "i"), (r"(?:contact|reach)\s+(?:me|out)", "i")]),
    "FAQ": (["faq", "frequently asked", "questions", "q&a", "q:", "a:"], [(r"(?:frequently\s+asked\s+)?questions?", "i"), (r"^Q:\s*.+$", "m"), (r"\?\s*\n+[A-Z]", "")]),
    "BreadcrumbList": (["home", "breadcrumb", ">"], [(r"home\s*[>›»]\s*\w+", "i")]),
    "HowTo": (["how to", "step by step", "tutorial", "guide", "instructions", "steps", "step 1", "step 2"],
              [(r"how\s+to\s+\w+", "i"), (r"step\s+\d+[:.]", "i"), (r"(?:first|second|third|next|then|finally)[,:]?\s+\w+", "i"), (r"^\d+\.\s+\w+", "m")]),
}
STRONG = {
    "Product": [(r"add\s+to\s+cart", "i"), (r"buy\s+now", "i"), (r"\$[\d,]+(?:\.\d{2})?\s*(?:USD|CAD|EUR)?", ""), (r"(?:in|out\s+of)\s+stock", "i"), (r"sku[:\s]+[\w-]+", "i")],
    "Article": [(r"^#\s+.+", "m"), (r"published\s+(?:on\s+)?(?:\w+\s+\d+,?\s+\d{4})", "i"), (r"by\s+[A-Z][a-z]+\s+[A-Z][a-z]+", ""), (r"\d+\s+min(?:ute)?s?\s+read", "i")],
    "FAQ": [(r"^Q:\s*.+$", "m"), (r"^A:\s*.+$", "m"), (r"frequently\s+asked\s+questions", "i")],
    "HowTo": [(r"^step\s+\d+[:.]", "im"), (r"how\s+to\s+\w+", "i"), (r"^\d+\.\s+\w+.*\n\d+\.\s+\w+", "m")],
}
AGAINST = {
    "Product": [r"\b(?:article|blog|post|news|story)\b", r"\b(?:how to|guide|tutorial|learn)\b", r"\b(?:opinion|analysis|thoughts on)\b", r"\b(?:published|written by|author|posted on)\b",
                r"\b(?:step \d+|first,|second,|finally,)\b", r"\b(?:faq|frequently asked|questions?)\b", r"\b(?:pricing strategy|how to price|cost of living)\b"],
    "Article": [r"\b(?:add to cart|buy now|checkout|purchase)\b", r"\b(?:in stock|out of stock|shipping|delivery)\b", r"\b(?:\$[\d,]+(?:\.\d{2})?)\s*(?:USD|CAD|EUR)?\s*(?:each|per|\/)", r"\b(?:sku|product code|item number)\b"],
    "FAQ": [r"\b(?:buy|purchase|order|cart|checkout)\b", r"\b(?:step \d+|how to|tutorial|guide)\b"],
    "HowTo": [r"\b(?:add to cart|buy now|checkout)\b", r"\b(?:faq|frequently asked)\b", r"\b(?:q:|a:|question:|answer:)\b"],
    "Organization": [r"\b(?:add to cart|buy now|checkout)\b", r"\b(?:step \d+|how to)\b", r"\b(?:q:|a:|faq)\b"],
    "Person": [r"\b(?:add to cart|buy now|checkout)\b", r"\b(?:our company|our team|we are)\b"],
}
#: Types that a type gives way to while scores are formed, and those that a confident first type drives out.
YIELDS_TO = {"Product": ["Article", "HowTo", "FAQ"], "Article": ["Product", "HowTo"], "HowTo": ["Product", "Article", "FAQ"], "FAQ": ["Product", "HowTo"], "Organization": ["Product", "Person"], "Person": ["Organization", "Product"]}
DRIVES_OUT = {"Product": ["Article", "HowTo"], "Article": ["Product"], "HowTo": ["Article"], "Organization": ["Person"], "Person": ["Organization"]}
KIND_OF = {"Product": "product", "Article": "blog", "FAQ": "faq", "HowTo": "howto"}  # the others are of kind landing
WEIGHTS = {"strong": 8, "pattern": 4, "keyword": 0.5, "against": -5, "context": -10}
