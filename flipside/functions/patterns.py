"""Character classes and regular expressions shared by every text function.

Java's ``\\w``, ``\\s``, ``\\d`` and ``\\b`` are ASCII by default and its Unicode mode counts
combining marks as letters, so the patterns below spell the classes out.
"""

WORD_CLASS = r"\p{L}\p{N}_"
SPACE_CLASS = r"\t-\r\x1c-\x1f\x{85}\p{Z}"

WORD = f"[{WORD_CLASS}]"
NOT_WORD = f"[^{WORD_CLASS}]"
SPACE = f"[{SPACE_CLASS}]"
NOT_SPACE = f"[^{SPACE_CLASS}]"

# Runs are possessive (++): nothing that follows could need a character back, and the matcher then
# keeps no states to return to, which makes tokenizing about twice as fast.
URL = f"https?://{NOT_SPACE}++|www\\.{NOT_SPACE}++"
MENTION = f"@{WORD}++"
HASHTAG = f"#({WORD}++)"
SPACES = f"{SPACE}++"
ALL_CAPS_WORD = f"(^|{NOT_WORD})[A-Z]{{2,}}+($|{NOT_WORD})"
DIGIT = r"\p{Nd}"
LETTER = r"\p{L}"

# The code points with the Unicode Uppercase property (category Lu, Roman numerals,
# circled, squared and negative circled and squared letters).
UPPER = r"[\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}]"

# The code points that count as emoji, in eight ranges (pictographs, emoticons,
# transport, regional indicators, two blocks of supplements, symbols, dingbats).
EMOJI = (
    r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]+"
)

# A token is a run of two or more word characters; the second form also keeps each ! and ?.
TOKEN = f"{WORD}{{2,}}+"
TOKEN_OR_PUNCTUATION = f"{TOKEN}|[!?]"
