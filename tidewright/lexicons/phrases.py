"""Stock phrases with the weight of each, 0.3 mild to 1.0 extreme. All entries are fixed values, in their natural order: category, weight and phrases."""

_DEFAULT = """
filler: 0.4 in today's world; 0.3 it is important to note; 0.4 as we all know; 0.4 needless to say; 0.5 at the end of the day; 0.3 in conclusion; 0.3 to sum up; 0.3 in summary; 0.4 first and foremost;
  0.4 last but not least; 0.5 without a doubt; 0.5 it goes without saying; 0.4 as a matter of fact; 0.5 for all intents and purposes; 0.3 in order to; 0.4 due to the fact that; 0.5 at this point in time;
  0.4 in the event that; 0.4 on a daily basis; 0.4 in the near future
marketing: 0.6 state of the art; 0.6 cutting edge; 0.7 best in class; 0.7 world class; 0.7 industry leading; 0.5 next generation; 0.7 game changing; 0.7 revolutionary; 0.6 innovative solution;
  0.6 seamless experience; 0.5 robust platform; 0.5 scalable solution; 0.6 turnkey solution; 0.5 end-to-end solution; 0.6 one-stop shop; 0.7 best of breed; 0.5 mission critical; 0.5 enterprise grade
corporate: 0.8 leverage synergies; 0.7 move the needle; 0.6 low hanging fruit; 0.7 think outside the box; 0.7 paradigm shift; 0.5 value proposition; 0.5 core competency; 0.4 best practices; 0.5 going forward;
  0.6 circle back; 0.6 touch base; 0.5 deep dive; 0.6 take it offline; 0.4 bandwidth; 0.7 synergy; 0.6 holistic approach; 0.5 actionable insights; 0.4 key takeaways
tech-buzzword: 0.5 ai-powered; 0.6 blockchain-based; 0.4 cloud-native; 0.4 data-driven; 0.3 machine learning; 0.5 digital transformation; 0.6 disruptive technology; 0.6 future-proof; 0.6 hyper-scale; 0.5 next-gen
urgency: 0.8 act now; 0.7 limited time; 0.7 exclusive offer; 0.7 special deal; 0.8 hurry; 0.8 don't miss out; 0.9 once in a lifetime; 0.7 while supplies last; 0.7 order now; 0.6 limited availability
superlative: 0.6 amazing; 0.6 incredible; 0.7 unbelievable; 0.6 fantastic; 0.5 awesome; 0.8 mind-blowing; 0.7 groundbreaking; 0.6 unprecedented; 0.8 best ever; 0.7 like never before; 0.6 one of a kind;
  0.7 second to none; 0.6 top notch; 0.7 world-renowned; 0.6 highly acclaimed; 0.4 award-winning
vague: 0.4 various; 0.4 numerous; 0.3 significant; 0.3 substantial; 0.3 considerable; 0.4 a lot of; 0.4 many people; 0.5 some experts; 0.5 studies show; 0.4 research suggests; 0.5 it is believed; 0.4 generally speaking
"""
_INDUSTRIES = {
    "saas": "tech-buzzword: 0.4 saas solution; 0.3 subscription-based; 0.3 multi-tenant; 0.3 api-first; 0.4 no-code; 0.4 low-code",
    "ecommerce": "marketing: 0.3 free shipping; 0.5 satisfaction guaranteed; 0.4 money back guarantee; 0.4 best seller; 0.5 customer favorite",
    "finance": "marketing: 0.7 financial freedom; 0.6 passive income; 0.6 wealth building\nurgency: 0.9 guaranteed returns\nmarketing: 0.8 risk-free",
    "health": "marketing: 0.5 clinically proven; 0.5 doctor recommended; 0.6 all natural\nsuperlative: 0.9 miracle cure\nurgency: 0.8 instant results",
}


def _read(table: str) -> list[tuple[str, float, str]]:
    out = []
    for line in table.replace("\n  ", " ").strip().splitlines():
        category, _, entries = line.partition(": ")
        for entry in entries.split(";"):
            weight, _, phrase = entry.strip().partition(" ")
            out.append((phrase, float(weight), category))
    return out


#: (phrase, weight, category)
WEIGHTED_PHRASES = _read(_DEFAULT)
INDUSTRY_PHRASES = {name: _read(table) for name, table in _INDUSTRIES.items()}
