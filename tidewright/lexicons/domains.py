"""Tables on domain names. All entries are fixed values, in their natural order. Scores of well-known domains are a parameter of the operators."""

ENDING_SCORES = {
    "gov": 90, "gov.uk": 90, "gov.au": 88, "gov.ca": 88, "gov.in": 85, "gov.sg": 86, "gov.nz": 85, "gov.za": 82, "gov.br": 82, "mil": 88, "int": 85,
    "edu": 85, "ac.uk": 85, "edu.au": 83, "edu.sg": 82, "edu.in": 80, "ac.jp": 82, "edu.cn": 78, "edu.br": 78, "edu.mx": 76,
    "org": 55, "net": 45, "com": 40,
    "co.uk": 50, "de": 48, "fr": 48, "jp": 48, "au": 48, "ca": 48, "nl": 47, "se": 47, "ch": 48, "at": 46, "be": 46, "dk": 46, "no": 46, "fi": 46, "ie": 45, "nz": 45, "sg": 46, "hk": 45,
    "in": 42, "br": 42, "mx": 40, "kr": 44, "tw": 42, "my": 40, "id": 38, "th": 38, "ph": 36, "vn": 36, "za": 40, "ae": 42, "il": 44, "pl": 42, "cz": 40, "hu": 38, "ro": 36, "tr": 38,
    "ar": 38, "cl": 38, "co": 42, "pe": 34, "ec": 32, "ng": 32, "ke": 32, "eg": 34, "pk": 32, "bd": 30,
    "io": 45, "dev": 45, "app": 44, "tech": 42, "ai": 45, "cloud": 42, "software": 40, "digital": 38, "systems": 38, "solutions": 36, "services": 36, "tools": 38, "codes": 36,
    "biz": 35, "info": 35, "pro": 38, "company": 35, "business": 35, "agency": 36, "consulting": 35, "partners": 35,
    "media": 38, "news": 40, "blog": 35, "press": 38, "tv": 40, "fm": 38, "video": 35, "photos": 32, "gallery": 30,
    "shop": 32, "store": 32, "market": 32, "buy": 30, "sale": 28, "deals": 28, "discount": 25, "cheap": 22,
    "xyz": 30, "online": 30, "site": 28, "website": 28, "club": 30, "space": 30, "life": 28, "world": 28, "today": 30, "live": 32, "rocks": 28, "ninja": 25,
    "top": 20, "work": 22, "click": 18, "link": 20, "win": 18, "download": 18, "stream": 20, "gdn": 15, "men": 15, "loan": 15,
}
ENDING_DEFAULT = 35

DICTIONARY_WORDS = (
    "cloud data code tech labs works hub base flow stack sync link node grid core edge wave spark beam bolt dash dock gate helm hive loop mesh nest path peak port pulse root seed shift "
    "snap spot swift track vault view wire zoom market trade sales leads deals growth scale boost reach engage convert retain acquire launch build blue green red black white gold silver "
    "bright clear fast quick smart simple easy open free"
).split()

OFFICIAL_SUBDOMAINS = (
    "www blog docs api dev developer developers help support status news press media ir careers jobs about legal privacy security enterprise business pro premium app mobile cloud "
    "platform console dashboard admin portal"
).split()

SUSPICIOUS_START = "^(?:best|top|free|cheap|buy|get|my|the|your|our|1st|first|real|true|official|legit)"
SUSPICIOUS_END = "(?:online|web|site|blog|news|info|hub|zone|world|guru|ninja|expert|pro|hq|central|direct|now|today|24|365)$"
