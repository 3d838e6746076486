"""Fixed text patterns of the cleaning stage.

These values must equal the reference's for equal results.
"""

# ---- fixed values (must match the reference) ---------------------------------
# URL pattern, four alternatives, as used for masking ([URL]) and stripping.
URL_PATTERN = (
    r"(https?:\/\/(?:www\.|(?!www))[a-zA-Z0-9][a-zA-Z0-9-]+[a-zA-Z0-9]\.[^\s]{2,}"
    r"|www\.[a-zA-Z0-9][a-zA-Z0-9-]+[a-zA-Z0-9]\.[^\s]{2,}"
    r"|https?:\/\/(?:www\.|(?!www))[a-zA-Z0-9]+\.[^\s]{2,}"
    r"|www\.[a-zA-Z0-9]+\.[^\s]{2,})"
)
# Characters that end a hashtag or a mention.
NAME_STOP_CLASS = r'[^ !@#$%^&*(),.?":{}|<>]'
HASHTAG_PATTERN = "#(" + NAME_STOP_CLASS + "*)"
MENTION_PATTERN = "@" + NAME_STOP_CLASS + "*"
# Mask tokens.
URL_TOKEN = "[URL]"
TAG_TOKEN = "[TAG]"
RT_TOKEN = "[RT]"
MEN_TOKEN = "[MEN]"
# Vocabulary specials, in id order 0..8.
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "[URL]", "[RT]", "[TAG]", "[MEN]"]
# Label spellings accepted by the label mapper.
LABEL_MAPPING = {"y": 1, "yes": 1, "true": 1, "t": 1, "n": 0, "no": 0, "false": 0, "f": 0}
# Encoded sample length, batch size, split cut points, masking rates.
MAX_SEQ_LENGTH = 64
BATCH_SIZE = 16
TRAIN_CUT = 0.8
TEST_CUT = 0.93
MASK_SHARE = 0.15
MASK_TOKEN_SHARE = 0.8
RANDOM_TOKEN_SHARE = 0.9
# Tokenizer limits.
MAX_WORD_CHARS = 100
VOCAB_SIZE = 30522
MIN_FREQUENCY = 2
LIMIT_ALPHABET = 1000
# ------------------------------------------------------------------------------

# The same URL pattern without the look-ahead, for engines on RE2 (DuckDB).
# Equal matches: "(?:www\.|(?!www))X" is spelled out as "www\.X" or a host not
# starting with "www".
URL_PATTERN_RE2 = (
    r"https?://(?:www\.(?:[a-zA-Z0-9][a-zA-Z0-9-]+[a-zA-Z0-9]|[a-zA-Z0-9]+)"
    r"|(?:[a-vx-zA-Z0-9][a-zA-Z0-9-]+[a-zA-Z0-9]|w[a-vx-zA-Z0-9-][a-zA-Z0-9-]*[a-zA-Z0-9]"
    r"|ww[a-vx-zA-Z0-9]|ww[a-vx-zA-Z0-9-][a-zA-Z0-9-]*[a-zA-Z0-9]|w{0,2}[a-vx-zA-Z0-9][a-zA-Z0-9]*|w{1,2}))"
    r"\.[^\s]{2,}"
    r"|www\.(?:[a-zA-Z0-9][a-zA-Z0-9-]+[a-zA-Z0-9]|[a-zA-Z0-9]+)\.[^\s]{2,}"
)
