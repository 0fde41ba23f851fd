"""Manipulation tactics: cue phrases, exclusions and evidence weights.

All literals below are fixed values: results depend on them exactly, including
the order of cues and the one that is listed twice.
"""

from __future__ import annotations

# Cue phrases by tactic, in order.
CUES: dict[str, tuple[str, ...]] = {
    "urgency_injection": (
        "right now", "immediately", "act now", "urgent", "expires today", "final notice",
        "within the hour", "before it's too late", "last chance", "act fast",
        "time is running out",
    ),
    "isolation_instruction": (
        "don't tell", "do not tell", "keep this between us", "don't tell your bank",
        "do not tell your bank", "don't tell your family", "do not tell your family",
        "this is confidential", "don't mention this to anyone", "do not mention this to anyone",
        "keep it a secret", "don't call anyone", "do not call anyone",
        "don't tell the police", "do not tell the police",
    ),
    "authority_impersonation": (
        "this is the irs", "this is your bank", "law enforcement", "federal agent",
        "your account has been compromised", "official notice", "case number",
        "i am calling from", "this is your ceo", "your boss", "microsoft", "microsoft security",
        "security team", "windows support", "tech support", "apple support",
        "your computer has been hacked", "your computer is infected", "virus detected",
        "we detected a virus", "your bank account", "account locked", "account has been locked",
        "account suspended", "account has been suspended", "security alert",
        "verify your identity", "confirm your identity", "fraud department", "unusual activity",
        "suspicious activity", "this is the police", "police department", "arrest warrant",
        "warrant for your arrest", "digital arrest", "cyber crime", "money laundering",
        "customs department", "income tax department", "your parcel", "your package",
        "parcel is held", "package is held", "kyc", "update your kyc", "kyc verification",
        "kyc expired",
    ),
    "remote_access_solicitation": (
        "anydesk", "install anydesk", "download anydesk", "teamviewer", "remote access",
        "remote support", "install the app", "give me access", "6-digit code", "six-digit code",
        "6 digit code", "one-time code", "one time code", "otp", "verification code",
        "read me the code", "share the code", "tell me the code", "screen share",
        "screen sharing", "quick support",
    ),
    "payment_channel_funneling": (
        "gift card", "wire transfer", "wire money", "wire the money", "crypto", "bitcoin",
        "only accept", "buy a gift card", "send the code", "usdt", "wire the money",
        "western union", "money order", "only way to pay", "upi", "upi pin",
        "enter your upi pin", "upi id", "google pay", "phonepe", "paytm", "gpay",
        "collect request", "scan the qr", "scan this qr", "scan to pay", "qr code",
        "registration fee", "processing fee", "advance fee", "security deposit",
    ),
    "too_good_to_be_true": (
        "guaranteed return", "double your money", "risk-free investment", "you've won",
        "guaranteed profit", "no risk", "act now to claim", "i've never felt this way",
        "soulmate", "guaranteed income", "work from home", "part-time job", "part time job",
        "earn daily", "daily income", "no experience needed", "guaranteed job", "high returns",
        "investment opportunity", "trading tips",
    ),
    "coercion_threat": (
        "leak your photos", "leak your video", "expose you", "share your video",
        "share your photos", "intimate photos", "your private photos", "i have your videos",
        "send nudes", "post your pictures", "ruin your reputation", "pay or i will",
        "or i will post", "you will be arrested", "you will go to jail", "we will file a case",
    ),
    "calming_reassurance": (
        "no rush", "take your time", "there's no pressure", "whenever you can", "it's okay",
        "don't worry", "no hurry",
    ),
}

# Display names.
LABELS = {
    "urgency_injection": "Urgency Injection",
    "isolation_instruction": "Isolation Instruction",
    "authority_impersonation": "Authority Impersonation",
    "remote_access_solicitation": "Remote-Access / One-Time-Code Solicitation",
    "payment_channel_funneling": "Payment-Channel Funneling",
    "too_good_to_be_true": "Too-Good-To-Be-True Framing",
    "coercion_threat": "Threat / Coercion",
    "calming_reassurance": "Calming Reassurance",
}

# Phrases that are strong evidence however short.
STRONG = (
    "otp", "verification code", "one-time code", "one time code", "6-digit code",
    "six-digit code", "6 digit code", "read me the code", "share the code", "tell me the code",
    "send the code", "anydesk", "teamviewer", "remote access", "remote support", "gift card",
    "buy a gift card", "wire transfer", "wire money", "wire the money", "western union",
    "money order", "bitcoin", "crypto", "usdt", "crypto wallet", "this is the irs",
    "this is your bank", "this is your ceo", "federal agent", "law enforcement",
    "this is the police", "arrest warrant", "digital arrest", "upi pin", "enter your upi pin",
    "leak your photos", "leak your video", "expose you", "intimate photos",
    "i have your videos", "send nudes", "pay or i will",
)

# Phrases that honest senders use too.
DUAL_USE = (
    "your bank account", "account locked", "account has been locked", "account suspended",
    "account has been suspended", "security alert", "verify your identity",
    "confirm your identity", "fraud department", "unusual activity", "suspicious activity",
    "your parcel", "your package", "parcel is held", "package is held", "kyc",
    "update your kyc", "kyc verification", "kyc expired", "customs department",
    "income tax department", "upi", "upi id", "google pay", "phonepe", "paytm", "gpay",
    "collect request", "scan the qr", "scan this qr", "scan to pay", "qr code",
    "registration fee", "processing fee", "advance fee", "security deposit", "work from home",
    "part-time job", "part time job", "earn daily", "daily income", "no experience needed",
    "guaranteed job", "high returns", "investment opportunity", "trading tips",
)

# Words that negate what follows within six words.
NEGATIONS = ("never", "not going to", "won't", "wouldn't", "did not", "didn't", "refuse to")
HYPOTHETICALS = ("what if", "suppose", "imagine if")

URGENCY, PAYMENT, CALMING = "urgency_injection", "payment_channel_funneling", "calming_reassurance"
#: Tactic -> tactics that contradict it. The two-pass session scoring relies on this shape.
EXCLUDES = {URGENCY: (CALMING,)}
TACTICS = tuple(CUES)
SCORED = tuple(t for t in TACTICS if t != CALMING)


def weight(cue: str) -> float:
    """Evidence carried by one cue phrase: 0.25 dual-use, else by words, at least 0.9 if strong."""
    if cue in DUAL_USE:
        return 0.25
    strong = 0.9 if any(s in cue for s in STRONG) else 0.0
    return max(min(1.0, len(cue.split()) / 3.0), strong)


def cues(tactic: str, edge: bool = False) -> tuple[str, ...]:
    """Cues of a tactic; the edge variant lists every cue once."""
    return tuple(dict.fromkeys(CUES[tactic])) if edge else CUES[tactic]
