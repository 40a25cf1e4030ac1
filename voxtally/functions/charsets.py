"""Regular-expression classes shared by the text functions.

All of them are written so that the JVM engine and RE2 read them alike. They
mean what Python's Unicode-aware ``\\s``, ``\\S`` and ``\\w`` mean; the shorthand
classes are avoided because every engine defines those differently.
"""

# Fixed values -----------------------------------------------------------------
# Characters below 256 are listed one by one: the JVM looks those up in a bit
# set, while it tests ranges one after the other.
WS_MEMBERS = r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x{85}\x{A0}\p{Z}"
WS = f"[{WS_MEMBERS}]"
NWS = f"[^{WS_MEMBERS}]"
WORD = r"[\p{L}\p{N}_]"

# Inside a character class.
KEPT_PUNCTUATION = r".,!\\?()"

BURMESE = r"\x{1000}-\x{109F}"
BURMESE_EXTENDED = r"\x{1000}-\x{109F}\x{AA60}-\x{AA7F}"

# A Burmese syllable starts at a consonant that is neither stacked under another
# one (virama before it) nor closes a syllable (asat or virama after it), at an
# independent vowel, at a great sa, at a digit or at a sign.
BURMESE_SYLLABLE_START = (
    r"(?<!\x{1039})[\x{1000}-\x{1021}](?![\x{1039}\x{103A}])"
    r"|[\x{1023}-\x{102A}\x{103F}\x{1040}-\x{104F}]"
)

# Marker characters for telling the legacy encoding from Unicode.
LEGACY_MARKERS = ("ဥ", "ဦ", "ဧ", "ဩ", "ဪ")
UNICODE_MARKERS = ("ဉ", "ည", "ဋ", "ဌ", "ဍ")
# ------------------------------------------------------------------------------
