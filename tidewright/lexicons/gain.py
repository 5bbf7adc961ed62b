"""What counts as information in a text. All entries are fixed values, in their natural order."""

#: Terms in capitals of two letters that count; longer ones always do.
SHORT_TERMS = "CI CD AI ML AR VR".split()
BRANDS = (
    "Apple|Google|Microsoft|Amazon|Tesla|Samsung|Sony|Nike|Adidas|Meta|Netflix|Spotify|Adobe|Intel|AMD|NVIDIA|Qualcomm|IBM|Oracle|Salesforce|Stripe|Shopify|Slack|Zoom|Uber|Lyft|Airbnb|Twitter|LinkedIn|"
    "Pinterest|Snapchat|TikTok|Reddit|Discord|Twitch|GitHub|GitLab|Atlassian|Notion|Figma|Canva|Dropbox|Box|Asana|Monday|Trello|Jira|Confluence|HubSpot|Mailchimp|Zendesk|Intercom|Segment|Mixpanel|Amplitude|"
    "Datadog|Splunk|Elastic|MongoDB|Redis|PostgreSQL|MySQL|Vercel|Netlify|Heroku|DigitalOcean|Cloudflare|Fastly|Akamai|AWS|GCP|Azure|OpenAI|Anthropic|Cohere|Hugging Face|Stability AI|Midjourney|DALL-E|"
    "Perplexity|Cursor|Replit|CodePen|StackOverflow|Medium|Substack|Ghost|WordPress|Squarespace|Wix|Webflow|Framer"
)
PRODUCTS = (
    r"iPhone|iPad|MacBook|iMac|AirPods|Apple Watch|Apple TV|HomePod|Vision Pro|Pixel|Galaxy|Note|Fold|Flip|PlayStation|Xbox|Nintendo Switch|Surface|Kindle|Echo|Alexa|Fire TV|Ring|Nest|Chromecast|Google Home|"
    r"ChatGPT|Claude|Gemini|Copilot|Bard|GPT-4|GPT-3|DALL-E|Midjourney|Stable Diffusion|Whisper|Codex|Model S|Model 3|Model X|Model Y|Cybertruck|Powerwall|Starlink|Windows|macOS|iOS|Android|Linux|Ubuntu|"
    r"Chrome|Firefox|Safari|Edge|VS Code|IntelliJ|PyCharm|WebStorm|Xcode|Android Studio|Docker|Kubernetes|Terraform|Ansible|Jenkins|CircleCI|GitHub Actions|Vercel|Next\.js|React|Vue|Angular|Svelte|Node\.js|"
    r"Deno|Bun|Python|JavaScript|TypeScript|Rust|Go|Swift|Kotlin"
)
UNITS = (
    r"%|percent|million|billion|thousand|trillion|GB|TB|MB|KB|MP|Hz|GHz|MHz|mAh|W|kW|MW|kg|lb|oz|g|ml|L|m|cm|mm|ft|in|mph|km/h|hours?|days?|weeks?|months?|years?|users?|customers?|downloads?|reviews?|ratings?|"
    r"stars?|points?|votes?|views?|clicks?|conversions?|sales?|revenue|employees?|members?|subscribers?|followers?|likes?|shares?|comments?|posts?|articles?|pages?|sessions?|visits?|impressions?"
)
CAMEL_EXCEPTIONS = ["JavaScript", "TypeScript", "PowerPoint", "WordPress"]
COMMON_WORDS = "The This That These What When Where Why How And But For With From".split()

#: Kind of fact: pattern, group. i at the front ignores letter case.
FACTS = {
    "term": (r"\b[A-Z][A-Z0-9]{1,}(?:-[A-Z0-9]+)?\b", 0),
    "brand": (rf"(?i)\b(?:{BRANDS})\b", 0),
    "product": (rf"(?i)\b(?:{PRODUCTS})\b", 0),
    "camel": (r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", 0),
    "number": (rf"(?i)\b\d+(?:\.\d+)?(?:\s*(?:{UNITS}))\b", 0),
    "price": (r"(?:\$|€|£|¥|₹|₽|₩|฿|₫|₱|₪|₴|₸|₺|₼|₾|₿)[\d,]+(?:\.\d{2})?", 0),
    "date": (r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b|\b\d{4}-\d{2}-\d{2}\b|\b(?:Q[1-4]|H[12])\s+\d{4}\b", 0),
    "version": (r"(?i)\bv?\d+\.\d+(?:\.\d+)?(?:-(?:alpha|beta|rc|preview|stable|lts))?\b", 0),
    "left": (r"(?i)\b(\w+)\s+(?:vs\.?|versus|compared to|better than|worse than|faster than|slower than)\s+(\w+)\b", 1),
    "right": (r"(?i)\b(\w+)\s+(?:vs\.?|versus|compared to|better than|worse than|faster than|slower than)\s+(\w+)\b", 2),
    "ranking": (r"(?i)\b(?:top\s+\d+|#\d+|(?:first|second|third|fourth|fifth)\s+(?:place|position|rank))\b", 0),
    "address": (r"https?://[^\s<>\"{}|\\^`\[\]]+", 0),
}
#: Marks that are no part of what a text says: pattern, what takes its place.
MARKS = [(r"#{1,6}\s*", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"<[^>]+>", " "), (r"\n+", " ")]
#: Worth of a fact by the first of these that it shows; 1 else.
WORTH = [(r"(?i)\d+(?:\.\d+)?(?:\s*(?:%|percent|million|billion))", 4), ("^http", 3), ("^[A-Z]{2,}", 2)]
