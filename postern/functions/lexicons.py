"""Word lists and constants of the scoring model: fixed values, each list in its published order."""

# Weighted phrases; a phrase found is consumed, in this order.
URGENCY = [
    ("act immediately or account will be suspended", 1.0),
    ("final notice", 0.8),
    ("time sensitive", 0.6),
    ("urgent", 0.4),
    ("asap", 0.3),
    ("immediately", 0.3),
    ("right away", 0.3),
    ("deadline", 0.4),
    ("expires", 0.4),
]
AUTHORITY = [
    ("required by law", 1.0),
    ("by order of the director", 0.9),
    ("mandatory compliance", 0.9),
    ("per company policy", 0.7),
    ("official notice", 0.6),
    ("official", 0.3),
    ("authorized", 0.3),
    ("audit", 0.4),
]
SECRECY = [
    ("strictly confidential: do not forward", 1.0),
    ("keep this between us", 0.9),
    ("off the record", 0.7),
    ("internal use only", 0.6),
    ("confidential", 0.3),
    ("discreet", 0.3),
    ("private", 0.2),
]

# Cue lists; a cue counts once if it is contained.
CREDENTIAL = [
    "password", "passcode", "otp", "one-time code", "verification code", "mfa", "2fa", "re-authenticate", "reauthenticate", "confirm your identity",
    "sign in to verify", "log in to confirm", "security code", "pin",
]
PAYMENT = [
    "invoice", "wire", "remittance", "payment", "bank details", "billing", "outstanding", "settlement", "credit", "acct", "account update", "refund",
]
CHANNEL_CHANGE = [
    "change the bank", "update the bank", "new bank account", "new account number", "change our bank", "revised bank", "amend the account",
    "change the account number", "new payment details", "update payment details", "corrected bank details", "change beneficiary", "new beneficiary",
]
EXEC_TITLES = [
    "ceo", "cfo", "coo", "cto", "ciso", "chief executive", "chief financial", "vice president", " vp", "director", "dean", "principal", "partner",
    "head of", "president", "founder", "chairman", "managing director", "gm",
]
GENERIC_SALUTATION = [
    "dear customer", "dear user", "dear staff", "dear member", "dear client", "dear sir", "dear madam", "dear account holder", "dear beneficiary",
    "dear team", "dear all", "dear friend", "valued customer",
]

# Extensions, hosts, domains and registrars.
DANGEROUS_EXT = [
    "exe", "scr", "js", "vbs", "lnk", "jar", "hta", "pif", "com", "cmd", "bat", "msi", "ps1", "wsf", "cpl", "reg", "sh", "vb", "jse",
]
MACRO_EXT = [
    "docm", "xlsm", "pptm", "dotm", "xltm", "xlam", "potm", "ppsm", "sldm",
]
ARCHIVE_EXT = [
    "zip", "rar", "7z", "tar", "gz", "bz2", "xz", "cab", "iso", "img",
]
DOUBLE_EXT = [
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "rtf", "jpg", "png", "gif", "csv",
]
SHORTENERS = [
    "bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly", "adf.ly", "bit.do", "cutt.ly", "rb.gy", "shorturl.at", "t.ly", "lnkd.in",
    "rebrand.ly", "s.id", "tiny.cc", "soo.gd", "clck.ru", "v.gd",
]
FREE_MAIL = [
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.uk", "hotmail.com", "hotmail.co.uk", "outlook.com", "live.com", "msn.com", "aol.com",
    "icloud.com", "me.com", "mac.com", "protonmail.com", "proton.me", "gmx.com", "gmx.de", "mail.com", "yandex.ru", "zoho.com", "fastmail.com",
]
SUSPICIOUS_TLD = [
    "tk", "ml", "ga", "cf", "gq", "top", "xyz", "click", "link", "work", "rest", "country", "kim", "science", "party", "review", "stream",
    "download", "loan", "racing", "win", "bid", "date", "faith", "trade", "accountant", "cricket", "men", "zip", "mov", "cam", "quest", "cfd", "sbs",
    "buzz",
]
RISKY_REGISTRARS = [
    "namecheap", "godaddy", "porkbun", "keybase", "njalla", "west", "enom", "namesilo", "dynadot", "bigcommerce",
]
PROXY_TOKENS = [
    "proxy", "socks", "socks4", "socks5", "webmail", "submission", "remotedesktop", "citrix", "rdp", "webex", "zoom", "tunnel", "http",
]
REDIRECT_PARAMS = [
    "url", "target", "next", "redirect", "dest", "continue", "u",
]

# The 60 features in vector order, by family.
FAMILIES = {
    "AUTH": [
        "spf_fail", "spf_none", "dkim_fail", "dkim_absent", "dmarc_fail", "dmarc_absent", "alignment_from_spf", "alignment_from_dkim",
        "dmarc_policy_strict",
    ],
    "ROUTE": [
        "rp_from_mismatch", "replyto_mismatch", "replyto_free_mail", "messageid_anomaly", "received_count_n", "received_disorder",
        "received_private_hop", "received_missing_from", "helo_mismatch", "date_skew",
    ],
    "IDENT": [
        "domain_age_inv", "domain_age_unknown", "lookalike_strong", "homoglyph_ratio", "digit_dash_ratio", "subdomain_depth", "suspicious_tld",
        "mx_absent", "rdap_privacy", "registrar_risk", "registrar_country_off",
    ],
    "NLP": [
        "urgency", "authority_claim", "credential_request", "payment_request", "payment_channel_change", "exec_impersonation", "secrecy_pressure",
        "generic_salutation", "grammar_anomaly", "tone_incongruence",
    ],
    "PAYLOAD": [
        "link_text_mismatch", "shortener", "ip_literal", "punycode", "at_in_url", "deep_redirect", "credential_form_host", "attachment_dangerous",
        "attachment_macro", "attachment_archive", "attachment_double_ext", "attachment_count_n",
    ],
    "INFRA": [
        "ip_in_blacklist", "asn_risk", "vpn_proxy", "tor_exit", "open_relay", "cloud_hosted", "geo_mismatch", "reputation_low",
    ],
}
FEATURES = [f for names in FAMILIES.values() for f in names]

# The hand-set model.
CLASSES = [
    "legitimate", "suspicious", "impersonation", "phishing", "bec", "fraud", "malware", "spam",
]
INTERCEPTS = [4.00, -0.60, -1.00, -0.20, -1.20, -1.70, -0.40, 0.60]
FAMILY_WEIGHTS = {
    "legitimate": [-1.8, -1.9, -1.2, -1.7, -0.9, -0.8],
    "suspicious": [0.8, 1.0, 0.9, 0.7, 0.5, 0.9],
    "impersonation": [0.7, 1.8, 1.2, 0.9, 0.3, 0.4],
    "phishing": [1.6, 0.8, 1.4, 1.6, 1.0, 0.5],
    "bec": [0.6, 1.1, 0.5, 1.9, 0.2, 0.4],
    "fraud": [0.5, 1.0, 0.7, 1.9, 0.3, 0.5],
    "malware": [0.4, 0.4, 0.4, 0.5, 1.9, 0.3],
    "spam": [0.5, 0.6, 0.7, 0.9, 0.3, 1.0],
}
BEC_INTERCEPT = -3.2
BEC_WEIGHTS = {
    "exec_impersonation": 0.30, "payment_channel_change": 0.85, "secrecy_pressure": 0.55, "urgency": 0.45, "authority_claim": 0.30,
    "replyto_mismatch": 0.25, "replyto_free_mail": 0.30, "received_count_n": 0.10, "domain_age_inv": 0.20, "dmarc_policy_strict": 0.15,
    "attachment_archive": 0.20,
}
CLIP, W_BEC, GAMMA, CONFIDENCE_CAP, TAU_CLUSTER = 2.5, 0.35, 0.7, 0.85, 0.62
GENESIS = "eb52dd73b251b57c8abe4e5c005fdbb5c4a4a7aa53e8d217ad8c973f9b50b1aa"
STIX_TYPES = [
    "bundle", "email-message", "email-addr", "domain-name", "ipv4-addr", "ipv6-addr", "url", "file",
]
