"""Values that decide results and therefore must not drift."""

import unicodedata

# Fixed values ---------------------------------------------------------------
# Text patterns. `{ws}` is the whitespace class below.

BOXED_FLAT = r"\\boxed\{([^{}]+)\}"
BOXED_NESTED = r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
NUMBER = r"[-+]?(?:\d+(?:,\d{3})*|\d+)(?:\.\d+)?(?:/\d+(?:\.\d+)?)?"
ANSWER_PHRASE = r"(?:the{ws}+answer{ws}+is|answer){ws}*:?{ws}*([^\n\.]+)"
CONCLUSION_PHRASE = r"(?:final answer|answer|therefore|so){ws}*(?:is|=|:)?{ws}*([^\n\.]+)"
TRAILING_EQUALS = r"(?:=){ws}*([^\n=]+)\z"
ARITHMETIC_MARK = r"<<[^>]+>>"
FINAL_MARKER = "####"
ANSWER_EDGE_CHARS = " .,:;"

LATEX_DELETED = ("$", "\\$", "\\left", "\\right", "\\,", "\\!", "\\ ")
LATEX_UNWRAPPED = r"\\(?:text|mathrm)\{([^{}]*)\}"
LATEX_FRACTION = r"\\frac\{([^{}]+)\}\{([^{}]+)\}"

# Numeric settings.

ANSWER_TOLERANCE = 1e-6
INTEGER_TOLERANCE = 1e-9
IGNORED_LABEL = -100
TRAIN_TIMESTEPS = 1000
SHARD_ROWS = 4096
SHARD_NAME_PREFIX = "latents-"
MEMORY_SLOTS = 3
COMPRESSION_RATE = 512
LATENT_DIM = 128
NOISE_DRAWS = 8
SAMPLE_NOISE = 0.3
CONDITION_DROP_PROB = 0.1
BANDWIDTH_OFFSET = 1e-6
MAX_QUESTION_TOKENS = 512
FIRST_ROWS_DENOMINATOR = 200
MIN_TOKENS_FOR_LM = 64
# End of fixed values --------------------------------------------------------

# Whitespace and line ends as Python's str methods see them: the characters for
# which str.isspace() holds, and the boundaries of str.splitlines().
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WHITESPACE_CLASS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


# Decimal digits beyond ASCII and their values, by the Unicode database.
OTHER_DIGITS = "".join(c for c in map(chr, range(0x80, 0x110000)) if c.isdecimal())
OTHER_DIGIT_VALUES = "".join(str(unicodedata.decimal(c)) for c in OTHER_DIGITS)


def with_whitespace(pattern: str) -> str:
    return pattern.replace("{ws}", WHITESPACE_CLASS)
