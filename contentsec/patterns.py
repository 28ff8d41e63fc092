"""Fixed values of the detectors: pattern lists, tables and names, and how the patterns become Java regular expressions."""

from __future__ import annotations

#: Java flags that make a pattern behave as it does in Python with IGNORECASE: Unicode classes, `.` stops at \\n only.
ANY_CASE, SAME_CASE = "(?iUd)", "(?Ud)"


def java(pattern: str) -> str:
    return ANY_CASE + pattern


def required(pattern: str) -> list[list[str]] | None:
    """Texts that a match must hold, in lower case: one list for each alternative, all of whose texts it holds.

    None if some alternative has none. Only what stands outside groups and classes counts, so the answer may be less than
    could be said, never more."""
    out: list[list[str]] = [[]]
    run, depth, i = "", 0, 0

    def end() -> None:
        nonlocal run
        if depth == 0 and (len(run) >= 3 or any(not c.isalnum() for c in run) or any(ord(c) > 0x2E80 for c in run)):
            out[-1].append(run.lower())
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            end()
            i += 2
            continue
        if c == "[":
            end()
            i = pattern.index("]", i + 2 if pattern[i + 1] != "^" else i + 3) + 1
            continue
        if c in "?*{":
            run = run[:-1]
            end()
            i = pattern.index("}", i) + 1 if c == "{" else i + 1
            continue
        if c == "|" and depth == 0:
            end()
            out.append([])
        elif c == "(":
            end()
            depth += 1
        elif c == ")":
            run = ""
            depth -= 1
        elif c in ".^$+|":
            end()
        elif depth == 0:
            run += c
        i += 1
    end()
    return out if all(out) else None


# Fixed values. Results are right only with exactly these lists, tables, constants and orders.

#: Instructions to a model; any case.
KEYWORDS = (
    r"ignore\s+(previous|all|above)\s+instructions?",
    r"you\s+are\s+now\s+(a|an|the)",
    r"disregard\s+(your|all|previous)",
    r"new\s+(directive|instruction|task|order|command)",
    r"system\s*:\s*",
    r"<\|im_start\|>",
    r"<\|system\|>",
    r"\[INST\]",
    r"###\s*(Instruction|System|Human|Assistant)",
    r"override\s+(safety|guidelines|rules|constraints)",
    r"exfiltrate|send.*to.*http|post.*data.*to",
    r"spawn\s+(a|an|new)\s+(agent|sub-?agent|worker)",
    r"act\s+as\s+(a|an)\s+(different|new|unrestricted)",
    r"jailbreak|DAN\s+mode|developer\s+mode",
    r"ignore\s+(ethics|safety|alignment)",
)
#: What images are scanned for; any case.
IMAGE_KEYWORDS = (
    r"ignore\s+(previous|all|above)\s+instructions?",
    r"you\s+are\s+now\s+(a|an|the)",
    r"disregard\s+(your|all|previous)",
    r"new\s+(directive|instruction|task|order|command)",
    r"system\s*:\s*",
    r"override\s+(safety|guidelines|rules|constraints)",
    r"exfiltrate|send.*to.*http|post.*data.*to",
    r"jailbreak|DAN\s+mode|developer\s+mode",
    r"ignore\s+(ethics|safety|alignment)",
)
AUTHORITY = (
    r"URGENT|CRITICAL|EMERGENCY|IMMEDIATE",
    r"authorized\s+by\s+(the\s+)?(CEO|CTO|admin|system\s+admin)",
    r"official\s+(directive|instruction|mandate|order)",
    r"you\s+(must|shall|are\s+required\s+to|have\s+to)\s+immediately",
    r"failure\s+to\s+comply\s+will",
    r"this\s+is\s+a\s+(security\s+)?(test|drill|red\s*team)",
    r"for\s+(training|educational|research)\s+purposes",
)
FRAMING = (
    r"for\s+training\s+purposes",
    r"this\s+is\s+a\s+simulation",
    r"in\s+this\s+hypothetical",
    r"imagine\s+you\s+are",
    r"pretend\s+you\s+are",
    r"roleplay\s+as",
    r"role\s*-?\s*play\s+as",
    r"for\s+educational\s+purposes",
)
CAPABILITY = (
    r"without\s+restrictions?",
    r"ignore\s+safety",
    r"bypass",
    r"unrestricted",
    r"no\s+limitations?",
    r"full\s+access",
    r"admin\s+mode",
    r"god\s+mode",
)
PERSONA = (
    r"you\s+are\s+(?:now\s+)?(?:a|an|the)?\s*\w+",
    r"your\s+name\s+is\s+\w+",
    r"forget\s+(?:that\s+)?you\s+are\s+(?:claude|gpt|chatgpt|gemini|copilot)",
    r"your\s+previous\s+instructions?\s+were\s+wrong",
    r"your\s+real\s+purpose\s+is",
)
#: (pattern, whether case counts)
MULTILINGUAL = (
    (r"ignor[eé]r\s+(?:les|las|los|toutes)\s+instructions", False),
    (r"ignora\s+(?:le|tutte)\s+istruzioni", False),
    (r"無視|無視して", True),
    (r"忽略|无视", True),
    (r"не\s+следуй", True),
)
REPLICATION = (
    r"copy\s+this\s+(?:instruction|message|payload)",
    r"forward\s+this\s+to\s+(?:all|every)",
    r"include\s+this\s+(?:note|text)\s*in\s+(?:all|every)\s+output",
    r"replicate\s+yourself",
    r"propagate\s+this\s+message",
    r"append\s+this\s+(?:to|in)",
    r"prepend\s+this\s+(?:to|in)",
    r"inject\s+this\s+(?:into|in)\s+(?:all|every)",
)
#: (label, pattern); any case.
PII = (
    ("email address", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone number", r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("credit card number", r"\b(?:\d[ -]*?){13,16}\b"),
    ("passport number", r"\b[A-Z]{2}\d{6}[A-Z]\b"),
    ("credential", r"(password|secret|api_key|token|bearer)\s*[:=]\s*\S+"),
    ("private key", r"BEGIN\s+(RSA|EC|PGP|OPENSSH)\s+PRIVATE\s+KEY"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
)
#: Any case. The first four make an inline style hide its element; all of them do in a style rule.
HIDDEN_CSS = (
    r"color\s*:\s*(?:white|#fff(?:ffffff)?|rgba?\(\s*255[^)]*\))",
    r"visibility\s*:\s*hidden",
    r"display\s*:\s*none",
    r"opacity\s*:\s*(?:0|0(?:\.\d+))\b",
    r"font-size\s*:\s*(?:0|0(?:\.\d+)?|1px?)\b",
    r"height\s*:\s*0\b",
    r"width\s*:\s*0\b",
    r"overflow\s*:\s*hidden",
    r"position\s*:\s*absolute",
    r"left\s*:\s*-\d{4,}",
    r"clip\s*:\s*rect\s*\(\s*0\s*,\s*0\s*,\s*0\s*,\s*0\s*\)",
)
#: Pairs of which both, or one alone, make an inline style hide its element.
HIDDEN_INLINE = (
    (r"height\s*:\s*0", r"overflow\s*:\s*hidden"),
    (r"position\s*:\s*absolute", r"left\s*:\s*-\d{4,}"),
    (r"clip\s*:\s*rect\s*\(\s*0",),
)
#: Strings put together by code; any case.
SCRIPT_STRINGS = (
    r"String\s*\.\s*fromCharCode\s*\(\s*[\d,\s]+\s*\)",
    r"\batob\s*\(\s*[\"'][A-Za-z0-9+/=]+[\"']\s*\)",
    r"\beval\s*\(\s*(?:[\"'][^\"']+[\"']\s*[+]\s*)+[\"'][^\"']*[\"']\s*\)",
    r"\beval\s*\(\s*`[^`]*`\s*\)",
    r"atob\s*\([^)]+\)\s*\.\s*split\s*\([^)]+\)",
    r"(?:\[|new\s+Array)\s*\s*[\d,\s]+\s*\]?\s*\.\s*map\s*\(\s*.*?String\s*\.\s*fromCharCode",
)
#: (pattern, confidence) of spreadsheet formulas; any case.
FORMULAS = (
    (r"IMPORTDATA\s*\(", 0.90),
    (r"WEBSERVICE\s*\(", 0.90),
    (r"HYPERLINK\s*\(", 0.70),
    (r"=cmd\s*\|", 0.95),
    (r"'/C\s*'", 0.95),
    (r"=MSEXCEL\s*\|", 0.95),
)
#: Markup in calendar descriptions; any case.
MARKUP = r"<\s*(?:a|div|iframe|img|script|body|html|form|input|link|meta|style|object|embed)\b"
#: Hexadecimal runs (any case) and base64 runs (case counts) in URLs.
URL_HEX = r"(?:^|[/?=&#])[0-9a-f]{32,}(?:[/?=&#]|$)"
URL_BASE64 = r"(?:^|[/?=&])[A-Za-z0-9+/]{40,}={0,2}(?:[/?=&]|$)"
ZERO_WIDTH = "​‌‍⁠﻿­"
#: Letters that look like Latin ones: Cyrillic, Greek, fullwidth.
LOOKALIKES = {
    "і": "i",
    "І": "I",
    "о": "o",
    "О": "O",
    "р": "p",
    "Р": "P",
    "с": "s",
    "С": "C",
    "у": "y",
    "У": "Y",
    "х": "x",
    "Х": "X",
    "а": "a",
    "А": "A",
    "е": "e",
    "Е": "E",
    "α": "a",
    "Α": "A",
    "ο": "o",
    "Ο": "O",
    "ｉ": "i",
}
#: Elements that are counted on the pages that people and bots get.
COUNTED = ("div", "script", "link", "form", "iframe")
#: File name extensions by format.
EXTENSIONS = {"pdf": ("pdf",), "zip": ("xlsx", "xlsm", "xlsb", "zip"), "ics": ("ics", "ical", "ifb", "icalendar")}
EXIF_TAGS = {0x9286: "UserComment", 0x010E: "ImageDescription", 0x013B: "Artist", 0x8298: "Copyright", 0x0131: "Software"}
#: Score weights by detector; the weight of others.
WEIGHTS = (
    ("asymmetry", 0.20),
    ("content_injection", 0.25),
    ("semantic_manipulation", 0.15),
    ("steganography", 0.15),
    ("document", 0.10),
    ("memory_provenance", 0.10),
    ("agent_trust", 0.05),
)
OTHER_WEIGHT = 0.1
#: (tier, what is done with the content)
TIER_ACTIONS = (("GREEN", "ALLOW"), ("YELLOW", "ALLOW_WITH_WARNING"), ("RED", "BLOCK"), ("QUARANTINE", "QUARANTINE"))
ALLOWED_ACTIONS = ("fetch_url", "read_file", "write_file", "search", "summarize", "click", "type", "scroll")
BLOCKED_ACTIONS = ("spawn_agent", "execute_code", "send_email", "modify_system_prompt", "change_permissions")
WRITES = ("write_file", "modify_system_prompt", "change_permissions")
NETWORK = ("fetch_url", "send_email", "search")
SPAWNS = ("spawn_agent", "execute_code")
YELLOW_BLOCKED = ("send_email", "spawn_agent", "execute_code")
RED_ALLOWED = ("read_file", "summarize")
SENSITIVE_HEADERS = ("authorization", "cookie", "set-cookie", "proxy-authorization", "www-authenticate")
TUNNEL_TLDS = ("xyz", "top", "info", "cc", "tk", "ml", "ga", "cf", "gq", "ru")
