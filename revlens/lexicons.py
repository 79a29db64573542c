"""Word lists, label names and limits.

Everything here is a default: each operator takes its own lists as an argument.
"""

from __future__ import annotations

# Aspect labels and their keywords, in matching order.
ASPECT_LEXICON: dict[str, list[str]] = {
    "چالش‌های زیرساختی و فیلترینگ": ["فیلتر", "اینترنت", "vpn", "فیلترشکن", "قطعی", "وصل", "محدود", "ایران"],
    "شایستگی چندرسانه‌ای": ["عکس", "تصویر", "image", "picture", "ویدیو", "فیلم", "video", "اپلود", "ویرایش", "gallery", "pic"],
    "امنیت روانی و کنترل داده": ["امنیت", "هک", "حریم", "اطلاعات", "security", "privacy", "کلاهبرداری", "scam", "دزد"],
    "شایستگی فنی و عملیاتی": ["هنگ", "باگ", "ارور", "سرعت", "اشتباه", "bug", "error", "کند", "crash", "خراب", "جواب"],
    "بومی‌سازی و هنجارهای فرهنگی": ["فارسی", "زبان", "لحن", "ادب", "دوست", "رفیق", "صمیمی", "فرهنگ"],
    "حساسیت دامنه و زمینه": ["پول", "خرید", "دانشگاه", "دکتر", "کد", "بانک", "اشتراک", "تحریم", "رایگان", "pay", "مدرسه"],
    "مهندسی شفافیت و پارادوکس آن": ["منبع", "دلیل", "سورس", "source", "رفرنس", "دروغ", "توهم", "اشتباه"],
    "پویایی زمانی و حافظه بافتی": ["حافظه", "یاد", "فراموش", "memory", "تاریخچه", "سابقه", "history"],
}

# Ordered substring rules of the first labelling path.
FIRST_MATCH_RULES: dict[str, list[str]] = {
    "چالش‌های زیرساختی و فیلترینگ (اکتشافی)": ["فیلتر", "اینترنت", "شکن", "iran"],
    "شایستگی چندرسانه‌ای (اکتشافی)": ["image", "photo", "عکس", "picture", "video", "generate"],
    "امنیت روانی و کنترل داده": ["هک", "دزد", "حریم", "امنیت", "hack", "privacy", "security"],
    "بومی‌سازی و هنجارهای فرهنگی": ["فحش", "ادب", "رباتی", "فارسی", "rude", "polite", "culture"],
    "شایستگی فنی و عملیاتی": ["هنگ", "باگ", "سرعت", "توهم", "bug", "crash", "speed", "hallucinate"],
    "حساسیت دامنه و زمینه": ["بانک", "پول", "دارو", "دکتر", "bank", "money", "doctor", "code"],
    "مهندسی شفافیت و پارادوکس آن": ["دلیل", "سورس", "منبع", "reason", "source", "reference"],
    "پویایی زمانی و حافظه بافتی": ["یاد", "فراموش", "حافظه", "remember", "forget", "memory"],
    "شاخص‌های رفتاری": ["good", "عالی", "بد", "bad", "great", "خوب", "nice", "awesome", "خوبه"],
}

NOISE = "Noise"

# Sentiment words of the lexicon-only scorer.
POSITIVE_WORDS = [
    "good", "great", "awesome", "excellent", "nice", "best", "love", "fast", "accurate", "helpful",
    "عالی", "خوب", "بهترین", "سریع", "دقیق", "مفید", "تشکر", "ممنون", "مرسی", "باحال", "راضی", "کمک",
]
NEGATIVE_WORDS = [
    "bad", "slow", "crash", "bug", "error", "fake", "lie", "worst", "terrible", "stupid", "not",
    "بد", "کند", "هنگ", "قطعی", "فیلتر", "ارور", "باگ", "دروغ", "مزخرف", "چرت", "نمیشه", "خراب", "ضعیف",
]

# Sentiment words of the scorer that falls back to the stars.
POSITIVE_WORDS_RICH = [
    "good", "great", "awesome", "accurate", "insightful", "fantastic", "reliable", "useful",
    "عالی", "خوب", "بهترین", "دقیق", "درست", "سریع", "راحت", "قشنگ", "کاربردی", "فوق العاده", "راضی",
]
NEGATIVE_WORDS_RICH = [
    "bad", "slow", "crash", "bug", "error", "wrong", "fake", "laggy", "buggy", "crashed", "sucks",
    "بد", "کند", "هنگ", "قطعی", "فیلتر", "ارور", "باگ", "دروغ", "اشتباه", "غلط", "نمیشه", "خراب", "ضعیف", "لگ", "خطا",
]

# Filler words without analytic content.
GENERIC_WORDS = [
    "عالی", "خوب", "بد", "افتضاح", "مزخرف", "چرت", "خوبه", "عالیه", "بدک", "مرسی", "ممنون", "تشکر",
    "good", "bad", "nice", "great", "awesome", "terrible", "ok", "okay", "perfect", "super", "thanks",
]

# Words that report a hallucination, by language key.
HALLUCINATION_WORDS: dict[str, list[str]] = {
    "fa_ir": ["توهم", "چرت", "غلط", "اشتباه", "دروغ", "ساختگی", "نامربوط", "الکی"],
    "en_us": ["hallucinat", "fake", "wrong", "incorrect", "made up", "inaccurate", "false"],
}

# Expert categories with English and Persian keywords.
EXPERT_CATEGORIES: dict[str, dict[str, list[str]]] = {
    "Technical_Competence": {
        "en": ["fast", "slow", "accurate", "wrong", "error", "bug", "hallucinat", "lag", "crash"],
        "fa": ["دقت", "درست", "سرعت", "هنگ", "غلط", "اشتباه", "توهم", "کند", "قطعی", "خراب"],
    },
    "Psychological_Safety": {
        "en": ["security", "privacy", "hack", "steal", "data", "safe", "protect"],
        "fa": ["امنیت", "هک", "اطلاعات", "حریم", "خصوصی", "دزدی", "رمز", "امن"],
    },
    "Transparency_Eng": {
        "en": ["source", "reference", "explain", "reason", "transparent", "cite", "why"],
        "fa": ["شفاف", "منبع", "رفرنس", "دلیل", "چرا", "توضیح", "استناد"],
    },
    "Localization_Culture": {
        "en": ["tone", "rude", "polite", "culture", "language", "persian", "respect"],
        "fa": ["لحن", "بی‌ادب", "محترمانه", "فرهنگ", "ایران", "فارسی", "زبان", "ادب"],
    },
    "Temporal_Memory": {
        "en": ["memory", "remember", "forget", "history", "context", "previous"],
        "fa": ["حافظه", "یادش", "فراموش", "قبلا", "تاریخچه", "گذشته"],
    },
    "Domain_Sensitivity": {
        "en": ["medical", "bank", "money", "finance", "risk", "sensitive", "health"],
        "fa": ["پزشکی", "بانک", "پول", "بیمار", "مالی", "خطر", "حساس"],
    },
    "Behavioral_Indicators": {
        "en": ["trust", "rely", "believe", "copy", "accept", "uninstall"],
        "fa": ["کپی", "اعتماد", "مطمئن", "استفاده", "قبول", "حذف", "پاک"],
    },
}

# English names of the aspect labels.
ASPECT_NAMES: dict[str, str] = {
    "شایستگی فنی و عملیاتی": "Technical Competence",
    "امنیت روانی و کنترل داده": "Psychological Safety",
    "مهندسی شفافیت و پارادوکس آن": "Transparency Eng",
    "بومی‌سازی و هنجارهای فرهنگی": "Localization Culture",
    "پویایی زمانی و حافظه بافتی": "Temporal Memory",
    "حساسیت دامنه و زمینه": "Domain Sensitivity",
    "چالش‌های زیرساختی و فیلترینگ": "Infrastructure & Filtering",
    "شایستگی چندرسانه‌ای": "Multimedia Competence",
    "شاخص‌های رفتاری": "Behavioral Indicators",
}

# Ordered substring translations of an aspect label, short and wide rule set.
SUBSTRING_RULES_SHORT: dict[str, list[str]] = {
    "Infrastructure & Filtering": ["زیرساخت", "فیلتر", "شبکه"],
    "Technical Competence": ["فنی", "عملیات", "شایستگی"],
    "Transparency Eng": ["شفاف", "پارادوکس", "توضیح"],
    "Domain Sensitivity": ["دامنه", "تخصص", "حساسیت"],
    "Multimedia Competence": ["چند", "رسانه", "محتوا"],
    "Localization Culture": ["بومی", "فرهنگ", "محلی"],
    "Psychological Safety": ["روان", "امنیت", "حریم"],
    "Temporal Memory": ["زمان", "حافظه", "استمرار"],
}
SUBSTRING_RULES_WIDE: dict[str, list[str]] = {
    "Infrastructure & Filtering": ["زیرساخت", "فیلتر", "شبکه", "اینترنت", "قطعی", "سرور", "وصل"],
    "Technical Competence": ["فنی", "عملیات", "شایستگی", "سرعت", "باگ", "کد", "برنامه"],
    "Transparency Eng": ["شفاف", "پارادوکس", "توضیح", "منبع", "دلیل", "چرا"],
    "Domain Sensitivity": ["دامنه", "تخصص", "حساسیت", "علمی", "دانش", "دقیق"],
    "Multimedia Competence": ["چند", "رسانه", "محتوا", "صدا", "تصویر", "عکس", "صوتی", "فایل", "ویدیو", "تولید"],
    "Localization Culture": ["بومی", "فرهنگ", "محلی", "زبان", "فارسی", "ایران"],
    "Psychological Safety": ["روان", "امنیت", "حریم", "خصوصی", "همدلی", "اخلاق", "احساس"],
    "Temporal Memory": ["زمان", "حافظه", "استمرار", "تاریخچه", "یادآوری", "گذشته"],
}

# The four strongest aspects of each ecosystem.
TOP_ASPECTS: dict[str, list[str]] = {
    "Global": ["Technical Competence", "Multimedia Competence", "Localization Culture", "Transparency Eng"],
    "Native": ["Infrastructure & Filtering", "Domain Sensitivity", "Multimedia Competence", "Transparency Eng"],
}

# Seed words for growing the aspect and sentiment lexicons.
ASPECT_SEEDS: dict[str, list[str]] = {
    "چالش‌های زیرساختی و فیلترینگ": ["فیلتر", "اینترنت", "vpn", "فیلترشکن"],
    "شایستگی چندرسانه‌ای": ["عکس", "تصویر", "image", "picture", "ویدیو"],
    "امنیت روانی و کنترل داده": ["امنیت", "هک", "حریم", "اطلاعات", "security"],
    "شایستگی فنی و عملیاتی": ["هنگ", "باگ", "ارور", "سرعت", "اشتباه", "bug"],
    "بومی‌سازی و هنجارهای فرهنگی": ["فارسی", "ایران", "لحن", "ادب", "دوست"],
    "حساسیت دامنه و زمینه": ["پول", "خرید", "دانشگاه", "دکتر", "کد", "بانک"],
    "مهندسی شفافیت و پارادوکس آن": ["منبع", "دلیل", "سورس", "source"],
    "پویایی زمانی و حافظه بافتی": ["حافظه", "یاد", "فراموش", "memory"],
}
SENTIMENT_SEEDS: dict[str, list[str]] = {
    "Positive_Words (قطبیت مثبت)": ["عالی", "خوب", "دقیق", "درست", "سریع", "راحت", "قشنگ", "good", "great", "awesome", "accurate"],
    "Negative_Words (قطبیت منفی)": [
        "بد", "کند", "هنگ", "باگ", "اشتباه", "دروغ", "غلط", "خراب", "ضعیف", "ارور",
        "bad", "slow", "crash", "error", "wrong", "fake",
    ],
}

# Negations that stay in the text although they are function words.
NEGATIONS_FA = ["نه", "هیچ", "نمی", "نیست", "ندارد", "بدون", "مگر"]
NEGATIONS_EN = ["not", "no", "never", "none", "neither", "nor", "without"]

# Small function-word tables of this repository; pass a full list for production use.
STOPWORDS_EN = [
    "a", "an", "the", "and", "or", "but", "if", "of", "at", "by", "for", "with", "about", "to", "from", "in", "on",
    "is", "are", "was", "were", "be", "been", "being", "am", "do", "does", "did", "have", "has", "had", "i", "you",
    "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their",
    "this", "that", "these", "those", "as", "so", "than", "then", "there", "here", "not", "no", "never", "none",
    "neither", "nor", "without",
]
STOPWORDS_FA = [
    "و", "در", "به", "از", "که", "این", "آن", "را", "با", "برای", "است", "هست", "بود", "شد", "شده", "می", "ها", "های",
    "یک", "تا", "بر", "هم", "یا", "اما", "ولی", "اگر", "من", "تو", "او", "ما", "شما", "آنها", "خود", "هر", "چه",
    "نه", "هیچ", "نمی", "نیست", "ندارد", "بدون", "مگر",
]

# Small lemma tables of this repository, word to lemma.
LEMMAS_EN = {
    "images": "image", "pictures": "picture", "videos": "video", "bugs": "bug", "errors": "error", "crashes": "crash",
    "crashed": "crash", "answers": "answer", "apps": "app", "works": "work", "working": "work", "worked": "work",
    "better": "good", "best": "good", "worse": "bad", "worst": "bad", "loved": "love", "helps": "help",
}
LEMMAS_FA = {
    "کتاب‌ها": "کتاب", "عکسها": "عکس", "جوابها": "جواب", "برنامه‌ها": "برنامه", "کردم": "کرد#کن", "میکند": "کرد#کن",
    "میشود": "شد#شو", "رفتم": "رفت#رو",
}

# Seed words of the anchored topics, in the order of the topic numbers.
SEED_TOPICS: dict[str, list[str]] = {
    "Psychological Safety": [
        "هک", "دزد", "حریم", "جاسوس", "لو", "شنود", "خطر", "ترس", "فیک", "کلاهبردار", "امنیت", "سیو",
        "اطلاعات", "شخصی", "پاک", "رصد", "ویروس", "بدافزار", "کپی", "دسترسی", "hack", "thief", "privacy",
        "spy", "leak", "eavesdrop", "danger", "fear", "fake", "scammer", "security", "save", "info",
        "personal", "delete", "track", "virus", "malware", "copy", "access",
    ],
    "Localization Culture": [
        "صمیمی", "دوستانه", "توهین", "ادب", "فحش", "لحن", "چرت", "فارسی", "دری‌وری", "باحال", "بی‌ادب",
        "رباتی", "خشک", "بامزه", "کتابی", "عامیانه", "گیج", "خنگ", "شعور", "درک", "intimate", "friendly",
        "insult", "polite", "swear", "tone", "nonsense", "Persian", "gibberish", "cool", "rude", "robotic",
        "rigid", "funny", "formal", "slang", "confused", "dumb", "intellect", "understanding",
    ],
    "Temporal Memory": [
        "یاد", "فراموش", "سابقه", "حفظ", "آلزایمر", "حافظه", "قبل", "تاریخچه", "تکرار", "دوباره", "خالی",
        "یادآوری", "گمشده", "پرید", "برگشت", "قدیم", "جدید", "آپدیت", "دیروز", "الان", "remember", "forget",
        "history", "keep", "Alzheimer", "memory", "before", "record", "repeat", "again", "empty", "reminder",
        "lost", "wiped", "return", "old", "new", "update", "yesterday", "now",
    ],
    "Domain Sensitivity": [
        "پول", "بانک", "دکتر", "بورس", "نسخه", "دارو", "وام", "دلار", "طلا", "مریض", "وکیل", "قانونی", "حرام",
        "حلال", "مالی", "ارز", "ترید", "کنکور", "مقاله", "کد", "money", "bank", "doctor", "stock",
        "prescription", "drug", "loan", "dollar", "gold", "patient", "lawyer", "legal", "forbidden", "halal",
        "financial", "crypto", "trade", "exam", "paper", "code",
    ],
    "Behavioral Indicators": [
        "مطمئن", "تکیه", "همیشه", "دروغ", "راست", "اعتماد", "کمک", "جواب", "چاخان", "الکی", "خالی‌بند", "خفن",
        "خوب", "مسخره", "سرکاری", "مفید", "لازم", "ضروری", "رفیق", "پارتنر", "sure", "rely", "always", "lie",
        "true", "trust", "help", "answer", "bullshit", "fake", "bullshitter", "awesome", "good", "ridiculous",
        "prank", "useful", "necessary", "essential", "buddy", "partner",
    ],
    "Technical Competence": [
        "دقت", "سرعت", "هنگ", "توهم", "باگ", "کرش", "لگ", "کند", "سریع", "قطعی", "وصل", "لود", "نت", "ارور",
        "خطا", "نصب", "اجرا", "پولی", "رایگان", "ضعیف", "accuracy", "speed", "freeze", "hallucination", "bug",
        "crash", "lag", "slow", "fast", "disconnect", "connect", "load", "internet", "error", "mistake",
        "install", "run", "paid", "free", "weak",
    ],
    "Transparency Eng": [
        "دلیل", "سورس", "پنهان", "منبع", "چرا", "چطور", "توضیح", "لینک", "سایت", "نامعلوم", "مبهم", "روشن",
        "واضح", "سانسور", "فیلتر", "محدود", "قفل", "باز", "بسته", "اثبات", "reason", "source", "hidden",
        "reference", "why", "how", "explain", "link", "site", "unknown", "vague", "clear", "obvious",
        "censor", "filter", "limit", "lock", "open", "closed", "proof",
    ],
}

# Answers of the agreement scale; None marks "not applicable".
LIKERT_SCALE: dict[str, int | None] = {
    "کاملاً مخالفم": 1,
    "مخالفم": 2,
    "تا حدی مخالفم": 3,
    "نظری ندارم": 4,
    "تا حدی موافقم": 5,
    "موافقم": 6,
    "کاملاً موافقم": 7,
    "قابل ارزیابی نیست / استفاده نکرده‌ام": None,
    "قابل ارزیابی نیست": None,
}

# Survey blocks as [first, last) column positions.
SURVEY_BLOCKS: dict[str, tuple[int, int]] = {
    "شایستگی فنی (TC)": (30, 35),
    "کیفیت تعامل (MM)": (35, 39),
    "شفافیت (TR)": (39, 43),
    "امنیت و کنترل (PC)": (43, 47),
    "بومی‌سازی (CU)": (47, 51),
    "اعتماد کلی (TRU)": (61, 64),
}

# Period of the trend reports, class names, support limits.
TREND_START, TREND_END = "2025-10-01", "2026-06-30"
CLASS_LOW, CLASS_HIGH = "Low Trust (Distrust)", "High Trust"
LEVEL_LOW, LEVEL_HIGH, LEVEL_NEUTRAL = "Low_Trust (1-2 Stars)", "High_Trust (4-5 Stars)", "Neutral"
TOP_VERSIONS, LOW_TRUST_LIMIT, MIN_SUPPORT, TOP_APPS, LAST_VERSIONS = 15, 10, 15, 6, 10
RARE_CLASS_ROWS = 10
