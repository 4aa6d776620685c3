"""An independent, slow reading of the text rules, for tests only: it walks characters
and words one by one where the engine uses patterns."""

import unicodedata

from prosegauge import fixed

SPACE = set(fixed.WHITESPACE)


def chunks(text):
    out, now = [], ""
    for c in text + " ":
        if c in SPACE:
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return out


def tokens(text):
    out, every = [], chunks(text)
    for k, chunk in enumerate(every):
        if chunk in fixed.IGNORED_MARKERS:
            continue
        following = every[k + 1] if k + 1 < len(every) else None
        closed = chunk not in fixed.TOKEN_ABBREVIATIONS and (following is None or following[0].isupper())
        parts = [""]
        for c in chunk:
            if c in fixed.TOKEN_DELIMITERS:
                parts.append("")
            else:
                parts[-1] += c
        for j, part in enumerate(parts):
            while part and part[0] in fixed.OPENERS:
                part = part[1:]
            if j == len(parts) - 1 and closed and not is_outline(part):
                end = len(part)
                while end and part[end - 1] in fixed.CLOSERS:
                    end -= 1
                if end and part[end - 1] in ".!?":
                    part = part[: end - 1] + part[end:]
            while part and part[-1] in fixed.TRAILERS:
                part = part[:-1]
            if part:
                out.append(part)
    return out


def is_outline(part):
    pieces = part[:-1].split(".") if part else []
    if part.endswith(")"):
        return len(pieces) == 1 and pieces[0].isdecimal()
    return part.endswith(".") and bool(pieces) and all(p.isdecimal() for p in pieces)


def estimate(letters):
    letters = "".join(c for c in letters.lower() if "a" <= c <= "z")
    if len(letters) <= 3:
        return min(1, len(letters))
    groups = sum(c in "aeiouy" and (k == 0 or letters[k - 1] not in "aeiouy") for k, c in enumerate(letters))
    for end, unless in (("e", ("le", "ye")), ("es", ("aes", "ees", "oes")), ("ed", ("ted", "ded"))):
        if letters.endswith(end) and not letters.endswith(unless) and groups > 1:
            groups -= 1
    return max(1, groups)


def is_letter(c):
    return c.isalnum() and not c.isdecimal()


def words_of(core):
    """Runs of letters, joined by single apostrophes and hyphens between letters."""
    out, now = [], ""
    for k, c in enumerate(core):
        joint = c in "'’-" and now and is_letter(now[-1]) and k + 1 < len(core) and is_letter(core[k + 1])
        if is_letter(c) or joint:
            now += c
        else:
            out.append(now)
            now = ""
    return [w for w in [*out, now] if w]


def syllables(token):
    core = token.strip(fixed.SYLLABLE_STRIPPED)
    if token in fixed.IGNORED_MARKERS or not core:
        return 0
    if "@" in core:
        ascii_only = "".join(c if c.isascii() and (c.isalpha() or c in "'-") or c == "’" else " " for c in core)
        return sum(estimate(w) for w in "".join(ascii_only).split() if any(c.isalpha() for c in w))
    amount = number(core)
    if amount is not None:
        return amount
    if any(c.isdigit() for c in core) and any(c.isalpha() for c in core):
        return 1
    total = 0
    for word in words_of(core):
        plain = "".join(c for c in unicodedata.normalize("NFKD", word) if c.isascii())
        total += fixed.SYLLABLE_EXCEPTIONS.get(word.casefold(), estimate(plain))
    return total


def number(core):
    body = core.removeprefix("$").removesuffix("%")
    whole, dot, rest = body.partition(".")
    if not whole or not whole[0].isdecimal() or not all(c.isdecimal() or c == "," for c in whole) or (dot and not rest.isdecimal()):
        return None
    digits = sum(c.isdecimal() for c in body)
    return max(1, digits + bool(dot) + (core.startswith("$") and digits > 1))


def passive(sentence, version):
    """(is passive, rule)."""
    words, gaps, now, gap = [], [], "", ""
    k = 0
    letter = lambda c: c.isascii() and c.isalpha()
    while k < len(sentence):
        if letter(sentence[k]):
            j = k
            while j < len(sentence) and letter(sentence[j]):
                j += 1
            if j + 1 < len(sentence) and sentence[j] in "'’" and letter(sentence[j + 1]):
                j += 1
                while j < len(sentence) and letter(sentence[j]):
                    j += 1
            words.append(sentence[k:j].lower().replace("’", "'"))
            gaps.append(gap)
            gap, k = "", j
        else:
            gap += sentence[k]
            k += 1
    stops = [any(c in ".;:!?" for c in g) for g in gaps]
    at = lambda n: words[n] if n < len(words) else None

    def participle(w):
        if version >= 4 and w in fixed.NO_PARTICIPLES:
            return False
        return w in fixed.IRREGULAR_PARTICIPLES or (len(w) >= 4 and w.endswith("ed"))

    def between(w):
        return w in fixed.INTERVENING or w.endswith("ly") or (version >= 4 and w == "indeed")

    for n, w in enumerate(words):
        get = w in fixed.GET_FORMS
        if not (get or w in fixed.BE_FORMS or (version >= 4 and w in fixed.CONTRACTED_BE)):
            continue
        for m in range(n + 1, min(len(words), n + 6)):
            if stops[m]:
                break
            c, following = words[m], at(m + 1)
            if participle(c):
                state = c in fixed.STATE_ADJECTIVES or following in fixed.STATE_COMPLEMENTS.get(c, ())
                exists = "there" in words[max(0, n - 2) : n] and following not in (None, "by")
                if not state and not exists and not (get and c in fixed.GET_RESULTS):
                    return True, fixed.PASSIVE_RULES[get]
                break
            if not between(c):
                break
    for n in range(1, len(words)):
        if words[n - 1] == "as" and participle(words[n]) and not (version >= 5 and words[n] == "defined"):
            for m in range(n + 1, min(len(words), n + 5)):
                if stops[m]:
                    break
                if words[m] == "by":
                    return True, fixed.PASSIVE_RULES[2]
                if not between(words[m]):
                    break
    return False, fixed.PASSIVE_RULES[3]
