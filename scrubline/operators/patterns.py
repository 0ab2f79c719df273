"""Regular expressions for the JVM, put together from parts.

Classes of letters, digits and white space are spelt out, so that they hold what Python's ``\\w``, ``\\d`` and ``\\s`` do. Repeated
groups are possessive: one that may backtrack costs the JVM a stack frame each time round. Where something might have to be given back, what
follows is looked at before a group is taken. Only acronyms are bounded, by ``GROUPS`` letters. A look-ahead for the first sign stands before what
is dear, so that most places are passed over at once.
"""

from __future__ import annotations

import re

GROUPS = 300
#: What Python's word class holds, to be put in brackets; likewise white space and its part that ends lines.
WORD, DIGIT = r"\p{L}\p{N}_", r"\p{Nd}"
BREAK = r"\n-\r\x1c-\x1e\x85\u2028\u2029"
BLANK = r"\t\x1f\x20\p{Zs}"
SPACE = BREAK + BLANK
#: Stands before white space, which is dear to tell as a class, so that most signs are passed over at once.
_MAYBE_SPACE = "(?![!-~])"
#: Letters outside ASCII that Python takes for i, s and k when case is ignored.
FOLDED = "İıſK"
EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
NUMBER_END = rf"(?:(?=\n?\z)|{EDGE})"


def after_none_of(chars: str) -> str:
    return f"(?<![{chars}])"


def times(what: str, least: int, most: int | None = None) -> str:
    return f"{what}{{{least}{'' if most == least else ',' if most is None else f',{most}'}}}"


# a digit class and a counted form of it, as short names for what follows
def _d(least: int, most: int | None = -1) -> str:
    return times(DIGIT, least, least if most == -1 else most)


YEAR = f"(?=[12]){after_none_of(WORD)}(?:19|20){_d(2)}(?![{WORD}])"

_UPTO3 = f"[1-9]{_d(0, 2)}"
#: A group of three digits that another sign of a word follows could only be given back.
_GROUPED = [f"{_UPTO3}(?:{sep}{_d(3)}(?![{WORD}]))++(?:{point}{DIGIT}*)?" for sep, point in ((",", r"\."), ("[ .]", ","))]
NUMBER = f"(?=[-+–,.{DIGIT}]){after_none_of(WORD + ',.')}[-+–]?(?:{'|'.join([*_GROUPED, f'{DIGIT}*?[,.]{DIGIT}+', f'{DIGIT}+'])}){NUMBER_END}"

_GAP = "[- .]?"
_COUNTRY = rf"(?:(?:\+?{DIGIT}+|{times('0', 1, 2)}{DIGIT}*?){_GAP})?"
_AREA = rf"(?:\(?{_d(3, 4)}\)?/?{_GAP})?"
_EXTENSION = rf"(?:[{SPACE}]?(?:ext\.?|[-#x])[{SPACE}]?{_d(2, 6)})?"
PHONE = f"(?=[+({DIGIT}])(?:{after_none_of(WORD + ')')}{_COUNTRY}{_AREA}{_d(3)}{_GAP}{_d(4)}{_EXTENSION}(?![{WORD}])|\\+?{_d(4, 5)}[ ./]{_d(6, 9)})"

#: Hosts and top-level domains share this class: letters, digits and, by its definition, : ; < = > ? @ [ and the backslash.
HOST = rf"[0-9:-@A-Za-z\[\\{FOLDED}]"
_HYPHENS = f"(?:-{HOST}++)*+"
_LABEL = f"{HOST}++{_HYPHENS}"
#: Labels that begin with one sign before a hyphen or the end; a domain can't end in these. Those that begin with more may end it, the last of them does.
_SHORT, _LAST_OF = rf"(?:\.{HOST}(?!{HOST}){_HYPHENS})*+", rf"\.{times(HOST, 2)}+"
DOMAIN = rf"{_LABEL}(?:{_SHORT}{_LAST_OF}{_HYPHENS}(?={_SHORT}{_LAST_OF}))*+{_SHORT}{_LAST_OF}"
_LOCAL = f"[-+{WORD}]++"
_AT = r"(?:@|[(<{\[][aA][tT][)>}\]])"
#: What a text must hold to have an e-mail address.
ANY_AT = _AT
#: Where a local part may begin: not after - or +, as it began earlier then; but there too if its run isn't long, or it's the first such place
#: after a sign that none begins after. At every - and +, a long run would be read again and again.
_BEGIN = f"(?>(?<![-+])|(?![-+{WORD}]{{1001}})|(?<=[@.)][{WORD}]{{0,1000}}[-+]))"
EMAIL = rf"{after_none_of(WORD + '@.)')}{_BEGIN}{_LOCAL}(?:\.{_LOCAL})*+{_AT}{DOMAIN}"


def _octets(n: int) -> str:
    return times(rf"(?:\.{_d(1, 3)})", n, n)


_PRIVATE = "".join(f"(?!{x})" for x in (f"(?:10|127){_octets(3)}", rf"(?:192\.168|169\.254){_octets(2)}", rf"172\.(?:1[6-9]|2{DIGIT}|3[01]){_octets(2)}"))
_FIRST = f"(?:{'|'.join((f'[1-9]{DIGIT}?', f'1{_d(2)}', f'2[01]{DIGIT}', '22[0-3]'))})"
_INNER = rf"(?:\.(?:{'|'.join((f'1?{_d(1, 2)}', f'2[0-4]{DIGIT}', '25[0-5]'))}))"
_LAST = rf"\.(?:{'|'.join((f'[1-9]{DIGIT}?', f'1{_d(2)}', f'2[0-4]{DIGIT}', '25[0-4]'))})"
_IP = f"{_PRIVATE}{_FIRST}{times(_INNER, 2, 2)}{_LAST}"
_SCHEME = rf"(?:[hH][tT][tT][pP][sS{FOLDED[2]}]?://|[fF][tT][pP]://|[wW]{{3}}{_d(0, 3)}\.)"
_LOCALHOST = "".join(f"[{c}{c.upper()}{FOLDED[2] if c == 's' else ''}]" for c in "localhost")
URL = f"(?=[hHfFwW]){after_none_of(WORD + '/.')}{_SCHEME}(?:[^{SPACE}]+@)?(?:{_IP}|{DOMAIN}|{_LOCALHOST})(?::{_d(2, 5)}(?![{WORD}]))?(?:/[^])}}{SPACE}]*)?"
URL = URL.replace("[^])}", r"[^\])}")

ISO = dict(zip("$ zł £ ¥ ฿ ₡ ₦ ₩ ₪ ₫ € ₱ ₲ ₴ ₹".split(), "USD PLN GBP JPY THB CRC NGN KRW ILS VND EUR PHP PYG UAH INR".split()))
CURRENCIES = f"(?:{'|'.join(re.escape(s) for s in ISO)})++"

_ALNUM = f"A-Za-z0-9{FOLDED}"
LONE_LETTER = rf"(?:\A|{_MAYBE_SPACE}[{SPACE}])[B-TV-Zb-tv-z, {FOLDED}](?=[{SPACE}]|\z)"
#: Brackets with their contents; one that nothing closes is matched, with all that follows, as group 1, so that it's looked at once.
SQUARE, CURLY = r"\[[^\]]++\]|(\[[^\]]++)\z", r"\{[^}]++\}|(\{[^}]++)\z"
_SYMBOLS, _MARKS = r"[!#(),./:;<>?@\\^_{|}~+·]", r"[\"%'*-]"
LONE_SYMBOLS = rf"(?={_SYMBOLS})(?<![{_ALNUM}]){_SYMBOLS}+(?![{_ALNUM}])"
LONE_MARK = rf"(?={_MARKS})(?<![{_ALNUM}]){_MARKS}(?![{_ALNUM}])"

#: White space as a whole, a line break with the blanks around it, blanks, and white space at the end.
SPACES = f"{_MAYBE_SPACE}[{SPACE}]++"
#: White space, and blanks, that aren't just one space.
WIDE_SPACES = rf"{_MAYBE_SPACE}(?:(?!\x20)[{SPACE}]|\x20(?=[{SPACE}]))[{SPACE}]*+"
WIDE_BLANKS = rf"{_MAYBE_SPACE}(?:(?!\x20)[{BLANK}]|\x20(?=[{BLANK}]))[{BLANK}]*+"
ANY_BREAKS = f"{_MAYBE_SPACE}(?<![{SPACE}])[{BLANK}]*+[{BREAK}][{SPACE}]*+"
ONE_BREAK = rf"(?:\G|(?<![{BLANK}]))[{BLANK}]*+(?:\r\n|[{BREAK}])[{BLANK}]*+"
NARROW_BREAKS = r"(?:\r\n|[\n\x0B])++"
NOT_BEFORE_BREAK = rf"(?!\n)[{SPACE}]++"
OUTER = rf"\A[{SPACE}]++|(?<![{SPACE}])[{SPACE}]++\z"

ACRONYM = rf"(?<![{WORD}])(?:{times('(?:[A-Z][.]?[-a-z0-9&/]?)', 1, GROUPS)}(?:[A-Z][.s]?|[0-9]s?)|[0-9]{times('(?:-?[A-Z])', 1, GROUPS)})(?![{WORD}])".replace("[-a-z0-9&/]", "[a-z0-9&/-]")
SENTENCE_GAP = rf"(?<=[!.?])[{SPACE}]+(?=[^{DIGIT}])"


def literal(token: str) -> str:
    """A replacement that is put in as it is, whatever ``$`` or backslash it holds."""
    return token.replace("\\", "\\\\").replace("$", "\\$")


def any_of_words(words) -> str:
    return f"{EDGE}(?:{'|'.join(java_quote(w) for w in words)}){EDGE}"


def java_quote(s: str) -> str:
    return "".join(f"\\{c}" if c in r"\.[]{}()<>*+-=!?^$|&#~/" else c for c in s)
