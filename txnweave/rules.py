"""Rule lists. They decide results, and their order is part of their meaning."""

from __future__ import annotations

# --- fixed values: extraction patterns (pattern, priority), tried by falling priority --------

AMOUNT_LAKH = r"([\d.]+)\s*(?:lakh|lac|L)s?\b"
AMOUNT = [
    (r"(?:Rs\.?|INR|₹)\s*([\d,]+(?:\.\d{1,2})?)", 10),
    (r"(?:Amt|Amount)[:\s]*([\d,]+(?:\.\d{1,2})?)", 8),
    (r"([\d,]+(?:\.\d{1,2})?)\s*(?:has been\s+)?(?:debited|credited|transferred)", 5),
    (r"(?:debited|credited|transferred|spent)\s+(?:Rs\.?|INR|₹)?\s*([\d,]+(?:\.\d{1,2})?)", 5),
]
TYPE_DEBIT = r"\b(debited|debit|withdrawn|sent|paid|spent)\b"
TYPE_CREDIT = r"\b(credited|credit|received|refund|cashback|reversed)\b"
DATE = [
    (r"on\s+(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})", 12),
    (r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b", 10),
    (r"\b(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4})\b", 8),
]
REFERENCE = [
    (r"(?:Ref(?:erence)?|UTR|UPI\s*Ref)[:\s#]*(\d{12,16})", 10),
    (r"(?:Txn|Transaction)\s*(?:ID|No|#)?[:\s]*([A-Z0-9]{10,20})", 8),
    (r"\b(\d{12})\b", 3),
]
ACCOUNT = [
    (r"(?:A/c|Acct?|Account)(?:\s*(?:no\.?|number))?[:\s]*(?:[*X]{2,})?(\d{4,})", 10),
    (r"from\s+(?:[*X]{2,})?(\d{4,})", 8),
    (r"ending\s+(?:with\s+)?(\d{4})", 6),
]
VPA = [
    (r"(?:VPA|to|from)\s+([a-zA-Z0-9._-]+@[a-zA-Z0-9]+)", 10),
    (r"\b([a-zA-Z0-9._-]+@(?:ybl|paytm|okaxis|oksbi|okhdfcbank|axl|ibl|upi|apl|fbl|icici|hdfcbank|sbi))\b", 8),
]
BANK = [(r"\b(HDFC|ICICI|SBI|Axis|Kotak|PNB|BOB|IDFC|Yes Bank|IndusInd|RBL|Federal)\b", 10)]
PAYMENT_METHOD = [(r"\b(UPI|IMPS|NEFT|RTGS|NACH)\b", 10), (r"\b(Debit Card|Credit Card|Card)\b", 8)]
FIELD_PATTERNS = {
    "amount": [(AMOUNT_LAKH, 15), *AMOUNT],
    "type": [(TYPE_DEBIT, 10), (TYPE_CREDIT, 10)],
    "date": DATE,
    "reference": REFERENCE,
    "account": ACCOUNT,
    "vpa": VPA,
    "bank": BANK,
    "payment_method": PAYMENT_METHOD,
}

# --- fixed values: merchants and categories --------------------------------------------------

VPA_APPS = {
    "ybl": "PhonePe", "paytm": "Paytm", "okaxis": "Google Pay", "oksbi": "Google Pay", "okhdfcbank": "Google Pay", "axl": "Google Pay",
    "ibl": "ICICI Bank", "upi": "Generic UPI", "apl": "Amazon Pay", "fbl": "Federal Bank", "icici": "ICICI Bank", "hdfcbank": "HDFC Bank", "sbi": "SBI",
}
#: (key, merchant, category)
MERCHANTS = [
    ("swiggy", "Swiggy", "food"), ("zomato", "Zomato", "food"), ("dominos", "Domino's", "food"),
    ("pizzahut", "Pizza Hut", "food"), ("mcdonalds", "McDonald's", "food"), ("burgerking", "Burger King", "food"),
    ("starbucks", "Starbucks", "food"), ("kfc", "KFC", "food"), ("subway", "Subway", "food"), ("dunkin", "Dunkin", "food"),
    ("blinkit", "Blinkit", "food"), ("zepto", "Zepto", "food"), ("bigbasket", "BigBasket", "food"),
    ("instamart", "Swiggy Instamart", "food"), ("amazon", "Amazon", "shopping"), ("flipkart", "Flipkart", "shopping"),
    ("myntra", "Myntra", "shopping"), ("ajio", "Ajio", "shopping"), ("nykaa", "Nykaa", "shopping"),
    ("meesho", "Meesho", "shopping"), ("snapdeal", "Snapdeal", "shopping"), ("tatacliq", "Tata Cliq", "shopping"),
    ("reliance", "Reliance", "shopping"), ("dmart", "D-Mart", "shopping"), ("croma", "Croma", "shopping"),
    ("vijaysales", "Vijay Sales", "shopping"), ("uber", "Uber", "transport"), ("ola", "Ola", "transport"),
    ("rapido", "Rapido", "transport"), ("irctc", "IRCTC", "transport"), ("redbus", "redBus", "transport"),
    ("makemytrip", "MakeMyTrip", "transport"), ("goibibo", "Goibibo", "transport"), ("yatra", "Yatra", "transport"),
    ("cleartrip", "Cleartrip", "transport"), ("easemytrip", "EaseMyTrip", "transport"), ("metro", "Metro", "transport"),
    ("fastag", "FASTag", "transport"), ("iocl", "Indian Oil", "transport"), ("bpcl", "Bharat Petroleum", "transport"),
    ("hpcl", "HP Petrol", "transport"), ("jio", "Jio", "utilities"), ("airtel", "Airtel", "utilities"),
    ("vi", "Vi", "utilities"), ("bsnl", "BSNL", "utilities"), ("tatapower", "Tata Power", "utilities"),
    ("adanigas", "Adani Gas", "utilities"), ("mahanagar", "Mahanagar Gas", "utilities"), ("bescom", "BESCOM", "utilities"),
    ("electricity", "Electricity", "utilities"), ("water", "Water Bill", "utilities"), ("gas", "Gas Bill", "utilities"),
    ("netflix", "Netflix", "entertainment"), ("prime", "Amazon Prime", "entertainment"),
    ("hotstar", "Disney+ Hotstar", "entertainment"), ("spotify", "Spotify", "entertainment"),
    ("bookmyshow", "BookMyShow", "entertainment"), ("pvr", "PVR", "entertainment"), ("inox", "Inox", "entertainment"),
    ("youtube", "YouTube", "entertainment"), ("zee5", "Zee5", "entertainment"), ("sonyliv", "SonyLiv", "entertainment"),
    ("jiocinema", "JioCinema", "entertainment"), ("apollo", "Apollo", "healthcare"), ("pharmeasy", "PharmEasy", "healthcare"),
    ("netmeds", "Netmeds", "healthcare"), ("1mg", "1mg", "healthcare"), ("practo", "Practo", "healthcare"),
    ("medplus", "MedPlus", "healthcare"), ("byjus", "Byju's", "education"), ("unacademy", "Unacademy", "education"),
    ("upgrad", "upGrad", "education"), ("coursera", "Coursera", "education"), ("udemy", "Udemy", "education"),
    ("vedantu", "Vedantu", "education"), ("zerodha", "Zerodha", "investment"), ("groww", "Groww", "investment"),
    ("upstox", "Upstox", "investment"), ("paytmmoney", "Paytm Money", "investment"), ("kuvera", "Kuvera", "investment"),
    ("coin", "Zerodha Coin", "investment"), ("lic", "LIC", "investment"), ("policybazaar", "PolicyBazaar", "investment"),
    ("acko", "Acko", "investment"), ("digit", "Digit Insurance", "investment"),
]
CATEGORY_WORDS = {
    "food": ["food", "restaurant", "cafe", "coffee", "lunch", "dinner", "breakfast", "snack", "meal", "pizza", "burger", "biryani", "curry", "thali"],
    "shopping": ["shopping", "purchase", "order", "buy", "shop", "store", "mart", "fashion", "clothing", "electronics", "mobile", "laptop"],
    "transport": ["cab", "taxi", "ride", "travel", "flight", "train", "bus", "petrol", "diesel", "fuel", "toll", "parking", "metro"],
    "utilities": ["recharge", "bill", "electricity", "water", "gas", "internet", "broadband", "postpaid", "prepaid", "dth"],
    "entertainment": ["movie", "ticket", "show", "subscription", "stream", "music", "game", "concert", "event"],
    "transfer": ["transfer", "sent", "paid", "payment"],
    "salary": ["salary", "wages", "income", "pay"],
    "healthcare": ["hospital", "clinic", "medicine", "pharmacy", "doctor", "health", "medical", "diagnostic"],
    "education": ["school", "college", "university", "course", "tuition", "fees", "education", "training"],
}
CATEGORY_SYNONYMS = {
    "food": "food", "dining": "food", "restaurant": "food", "grocery": "food", "shop": "shopping", "shopping": "shopping", "retail": "shopping",
    "travel": "transport", "transport": "transport", "cab": "transport", "utility": "utilities", "utilities": "utilities", "bill": "utilities",
    "entertainment": "entertainment", "movie": "entertainment", "transfer": "transfer", "payment": "transfer",
}
CATEGORIES = ["food", "shopping", "transport", "utilities", "entertainment", "transfer", "salary", "healthcare", "education", "investment", "other"]

# --- fixed values: message routing --------------------------------------------------------

GARBAGE_PATTERNS = [
    r"\bOTP\b", r"\bone.time.password\b", r"\bverification.code\b", r"\bverify.your\b", r"\bconfirm.your.identity\b", r"\bcvv\b",
    r"\bpin\b.*\bdo.not.share\b", r"\b\d{4,6}\b.*\bexpires?\b", r"\bvalid.for.\d+.min", r"\blogin.alert\b", r"\blogged.in\b",
    r"\bnew.device\b", r"\bnew.login\b", r"\bsecurity.alert\b", r"\bsign.in.attempt\b", r"\bpassword.changed\b",
    r"\bpassword.reset\b", r"\baccount.locked\b", r"\bunusual.activity\b", r"\b\d+%.off\b", r"\bdiscount\b",
    r"\bcashback.offer\b", r"\bflat.rs\b.*\boff\b", r"\bget.upto\b", r"\bwin.upto\b", r"\bexclusive.offer\b",
    r"\blimited.time\b", r"\bspecial.offer\b", r"\bsale.live\b", r"\bshop.now\b", r"\bbuy.now\b", r"\bsubscribe\b",
    r"\bunsubscribe\b", r"\bnewsletter\b", r"\bbill.due\b", r"\bbill.reminder\b", r"\bdue.date\b", r"\bpay.before\b",
    r"\bauto.debit.scheduled\b", r"\bemi.due\b", r"\bpayment.reminder\b", r"\bminimum.amount.due\b", r"\boutstanding.balance\b",
    r"\baccount.statement\b", r"\bmonthly.statement\b", r"\be.statement\b", r"\bstatement.ready\b", r"\bdownload.statement\b",
    r"\bout.for.delivery\b", r"\bdelivered.to\b", r"\bshipment.update\b", r"\btracking.number\b", r"\border.confirmed\b",
    r"\border.placed\b", r"\border.shipped\b", r"\brate.your.experience\b", r"\bleave.a.review\b", r"\bupdate.available\b",
    r"\bapp.update\b", r"\bdownload.app\b", r"\binstall.app\b", r"\bclick.here\b", r"\bvisit.us\b", r"\bcall.us\b",
    r"\bcontact.us\b", r"\bfollow.us\b", r"\bjoin.us\b", r"\blearn.more\b", r"\bread.more\b",
]
KEEP_PATTERNS = [
    r"\bdebited?\b", r"\bcredited?\b", r"\btransferred?\b", r"\bwithdra(?:wn|wal)\b", r"\bdeposited?\b", r"\breceived?\b",
    r"\bsent\b", r"\bpaid\b", r"\bpurchase\b", r"\btransaction\b", r"\btxn\b", r"\bupi\b", r"\bneft\b", r"\bimps\b", r"\brtgs\b",
    r"rs\.?\s*[\d,]+", r"inr\s*[\d,]+", r"₹\s*[\d,]+", r"a/c\s*\w+", r"acct?\s*\w+", r"account\s*\w+", r"ref\.?\s*:?\s*\d{10,}",
    r"upi.?ref\s*:?\s*\d{10,}",
]
TRANSACTION_WORDS = [
    "autopay", "cashback", "credited", "debited", "deposited", "emi", "imps", "mandate", "neft", "paid", "payment", "received",
    "refund", "rtgs", "transaction", "transfer", "upi", "withdrawn",
]
#: category -> words of senders (3 points each), words of the text (1 point each)
MAIL_CATEGORIES = {
    "finance": (
        ["hdfc", "icici", "sbi", "axis", "kotak", "pnb", "bob", "canara", "union bank", "idbi", "yes bank", "indusind", "bank", "banking", "credit card", "mutual fund", "zerodha", "groww", "upstox", "cred", "slice", "paytm", "phonepe", "gpay"],
        ["transaction", "statement", "balance", "debited", "credited", "payment", "transfer", "upi", "neft", "imps", "account", "investment", "dividend", "interest", "emi", "loan", "credit", "debit", "mandate", "autopay", "sip", "mutual fund"],
    ),
    "shopping": (
        ["amazon", "flipkart", "myntra", "ajio", "nykaa", "meesho", "bigbasket", "zepto", "blinkit", "swiggy", "zomato", "dunzo", "decathlon", "ikea", "pepperfry", "urban ladder"],
        ["order", "shipped", "delivered", "delivery", "tracking", "purchase", "cart", "checkout", "invoice", "receipt", "refund", "return", "exchange", "dispatched", "out for delivery"],
    ),
    "work": (
        ["linkedin", "indeed", "naukri", "glassdoor", "angel.co", "slack", "zoom", "teams", "meet", "jira", "confluence", "github", "gitlab", "bitbucket", "notion", "asana", "trello"],
        ["interview", "meeting", "agenda", "project", "deadline", "review", "standup", "sprint", "task", "report", "submission", "application", "resume", "cv", "job", "position", "hiring", "salary", "offer letter", "joining", "onboarding"],
    ),
    "newsletter": (
        ["substack", "medium", "morning brew", "digest", "newsletter", "daily", "weekly", "update", "news", "times", "hindu", "express"],
        ["newsletter", "digest", "weekly", "daily", "update", "news", "article", "read", "story", "trending", "top stories", "this week", "this month", "roundup", "edition"],
    ),
    "promotional": (
        ["offer", "deal", "discount", "sale", "promo", "marketing", "shopify", "mailchimp", "campaign"],
        ["offer", "discount", "sale", "deal", "coupon", "promo", "limited time", "exclusive", "special", "hurry", "ends soon", "flash sale", "clearance", "save", "% off", "free shipping", "buy now", "shop now", "don't miss"],
    ),
    "social": (
        ["facebook", "instagram", "twitter", "whatsapp", "telegram", "snapchat", "tiktok", "youtube", "reddit", "discord", "quora"],
        ["friend request", "like", "comment", "share", "mentioned", "tagged", "message", "follow", "notification", "birthday", "invitation", "event", "rsvp", "group"],
    ),
}

# --- fixed values: ordered keyword rules (label -> words), first hit wins ----------------------

KEYWORD_MERCHANTS = {
    "swiggy": ["swiggy", "swiggy@"],
    "zomato": ["zomato", "zomato@"],
    "dominos": ["dominos", "domino"],
    "mcdonalds": ["mcdonald", "mcd@"],
    "kfc": ["kfc@", "kfc "],
    "starbucks": ["starbucks", "sbux"],
    "amazon": ["amazon", "amzn", "amazon@"],
    "flipkart": ["flipkart", "fkrt"],
    "myntra": ["myntra"],
    "ajio": ["ajio"],
    "nykaa": ["nykaa"],
    "uber": ["uber"],
    "ola": ["ola@", "olacabs"],
    "rapido": ["rapido"],
    "metro": ["metro", "dmrc", "bmrc"],
    "airtel": ["airtel"],
    "jio": ["jio@", "reliancejio"],
    "vodafone": ["vodafone", "vi@"],
    "electricity": ["bescom", "electricity", "power"],
    "gas": ["indane", "bharat gas", "hp gas"],
    "bigbasket": ["bigbasket", "bb@"],
    "zepto": ["zepto"],
    "blinkit": ["blinkit", "grofers"],
    "dmart": ["dmart", "d-mart"],
}
KEYWORD_CATEGORIES = {
    "food": ["swiggy", "zomato", "dominos", "mcdonald", "kfc", "restaurant", "cafe", "food"],
    "shopping": ["amazon", "flipkart", "myntra", "ajio", "nykaa", "shopping"],
    "transport": ["uber", "ola", "rapido", "metro", "cab", "taxi", "fuel", "petrol"],
    "bills": ["airtel", "jio", "vodafone", "electricity", "water", "gas", "broadband"],
    "grocery": ["bigbasket", "zepto", "blinkit", "dmart", "grocery", "supermarket"],
    "entertainment": ["netflix", "prime", "hotstar", "spotify", "movie", "theatre"],
    "health": ["pharmacy", "medical", "hospital", "doctor", "health"],
    "education": ["school", "college", "course", "udemy", "education"],
}
KEYWORD_METHODS = {
    "upi": ["upi", "vpa", "@ybl", "@oksbi", "@okicici", "@paytm", "@axisbank", "@icici"],
    "neft": ["neft"],
    "imps": ["imps"],
    "rtgs": ["rtgs"],
    "card": ["card", "visa", "mastercard", "rupay", "credit card", "debit card"],
    "wallet": ["wallet", "paytm wallet", "phonepe wallet"],
}
KEYWORD_BANKS = {
    "hdfc": ["hdfc", "hdfcbank"],
    "icici": ["icici"],
    "sbi": ["sbi", "state bank"],
    "axis": ["axis"],
    "kotak": ["kotak"],
    "pnb": ["pnb", "punjab national"],
    "bob": ["bob", "bank of baroda"],
    "canara": ["canara"],
    "union": ["union bank"],
    "idbi": ["idbi"],
}
