"""Problem 2: variant spellings of the names of persons and organisations.

Method: a symmetric-delete index over the tokens of all distinct names finds tokens up to one edit apart; names with such
tokens in common are aligned by an optimal assignment of their tokens that permits initials, nicknames and abbreviations.
Entities that share a name, or have aligned ones, are linked, and linked entities belong together.

Distinct tokens are indexed first, so a deletion is a key only where two different tokens have it, and it is known how
many names it would bring together. A key of few names pairs them. A frequent one is refined, never dropped: names that
align share a second key at another place, and the pair of both is the key. For persons the second is a deletion or a
nickname of another token, or an initial; for organisations a deletion of another word, or, where all other words are
short forms, what a short form keeps (``_short_keys``; of several words the first letters). So ``bucket``, the number of
names from which a key is refined, changes the work but not the result. Classes that stay large are refined by a third
token where the names have one, and compared block by block.

A name with an initial in place of a first name stands for whoever it fits, so it links nothing to each other: an entity
known by such names only is joined to the one group of entities whose full names fit, if there is exactly one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import chain, combinations, groupby, islice, product
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.llm.components import components
from lodequery.operators.versions import current_version
from lodequery.storage import written

PERSON, ORGANIZATION = "PERSON", "ORGANIZATION"
#: Names that a key brings together and that are paired at once; keys of more are refined. Pairs of keys may have LARGE times as many.
BUCKET, LARGE = 32, 8
#: Shortest token of an organisation's name, and of a person's, that may carry an edit; longest token of a pair that must be so long.
INDEXED, EDITABLE = 4, 3
_BLOCK = 1000  # names of a large class that are compared at once with as many others
_MEMBERS = 1000  # entities of a group that are paired at once with as many others

#: Short forms of given names, as commonly listed, by the full form.
NICKNAMES = """
Alexander: Alex Sasha Xander Sandy Lex; Andrew: Andy Drew; Anthony: Tony; Barbara: Barb Babs; Benjamin: Ben Benny Benji;
Charles: Charlie Chuck Chas Chip; Christopher: Chris Kit Topher; Daniel: Dan Danny; David: Dave; Deborah: Deb Debbie Debby;
Dolores: Lola Lolita; Donald: Don Donny; Edward: Ed Eddie Ned Ted Teddy; Elizabeth: Liz Lizzie Beth Betty Eliza Lisa Libby Bess;
Francisco: Paco Pancho Curro Fran; Friedrich: Fritz Fred Freddy; Gabriela: Gabi Gaby; George: Georgie; Gregory: Greg;
Guadalupe: Lupe Lupita; Harold: Harry Hal; Heinrich: Heinz Heini Hinnerk; Henry: Hank Harry; Ignacio: Nacho;
James: Jim Jimmy Jamie; Jennifer: Jen Jenny Jenn; Johannes: Hannes Hans Jo; John: Johnny Jack; Jose: Pepe Chepe;
Joseph: Joe Joey Jo; Katherine: Kate Kathy Katie Kat Kitty; Kenneth: Ken Kenny; Lawrence: Larry Laurie; Leonard: Len Lenny;
Margaret: Maggie Meg Peggy Marge Greta; Matthew: Matt; Michael: Mike Mick Mickey Mikey; Nicholas: Nick Nico Nicky Klaus;
Patricia: Pat Patty Trish Tricia; Peter: Pete; Rebecca: Becky Becca; Richard: Rick Dick Rich Ricky Richie;
Robert: Rob Bob Bobby Robbie Bert; Ronald: Ron Ronnie; Samuel: Sam Sammy; Stephen: Steve; Susan: Sue Suzy Susie;
Theodore: Ted Theo Teddy; Thomas: Tom Tommy; Timothy: Tim; Victoria: Vicky Vicki Tori; Wilhelm: Willi Willy Wim;
William: Bill Billy Will Willie Liam
"""
#: Forms of address, and words of an organisation's name that tell nothing.
TITLES = "mr mrs ms miss mx dr prof professor sir dame herr frau hr fr sr sra don dona phd md esq"
FILLERS = "the and und y of de"
#: Legal forms, each with the spellings that mean the same.
LEGAL = """
inc incorporated; corp corporation; co company; ltd limited; llc; lp; llp; plc; gmbh gesellschaftmbh; ag aktiengesellschaft;
sa; bv; nv; kg; oy; ab; srl; spa; pty
"""
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"})


@dataclass(frozen=True)
class Lexicon:
    """The word lists that names are read with, in the formats of the constants above; give others for other languages."""

    nicknames: str = NICKNAMES
    titles: str = TITLES
    fillers: str = FILLERS
    legal: str = LEGAL
    known: dict = field(default_factory=dict, compare=False, repr=False)  # costs of token pairs

    def __getstate__(self):
        return {"nicknames": self.nicknames, "titles": self.titles, "fillers": self.fillers, "legal": self.legal, "known": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)

    @cached_property
    def full_forms(self) -> dict[str, frozenset[str]]:
        full: dict[str, set[str]] = {}
        for entry in self.nicknames.replace("\n", " ").split(";"):
            name, _, short = entry.lower().partition(":")
            for s in short.split():
                full.setdefault(s, set()).add(name.strip())
        return {s: frozenset(f) for s, f in full.items()}

    @cached_property
    def title_words(self) -> frozenset[str]:
        return frozenset(self.titles.split())

    @cached_property
    def filler_words(self) -> frozenset[str]:
        return frozenset(self.fillers.split())

    @cached_property
    def legal_forms(self) -> dict[str, str]:
        return {w: form.split()[0] for form in self.legal.replace("\n", " ").split(";") if form.split() for w in form.split()}

    def cost(self, kind: str, a: str, b: str) -> float | None:
        key = (kind, a, b)
        if key not in self.known:
            if len(self.known) >= 1 << 18:
                self.known.clear()
            self.known[key] = _person_cost(a, b, self) if kind == PERSON else _word_cost(a, b)
        return self.known[key]


DEFAULT = Lexicon()


def _fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.lower().translate(_LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c))


def person_tokens(name: str, lexicon: Lexicon = DEFAULT) -> tuple[str, ...]:
    """Given names first: "Surname, Given" is turned round, titles are dropped."""
    name = _fold(name)
    if name.count(",") == 1:
        last, given = name.split(",")
        name = f"{given} {last}"
    words = re.findall(r"[^\W_]+", re.sub(r"['’`]", "", name))
    kept = [w for w in words if w not in lexicon.title_words]
    return tuple(kept if kept else words)


def organization_tokens(name: str, lexicon: Lexicon = DEFAULT) -> tuple[str, ...]:
    """Words without fillers; letters set apart by points are one word, a legal form is the last token, marked by "="."""
    name = re.sub(r"\b(?:[^\W\d_]\.\s?){2,}|\b[^\W\d_](?:\.[^\W\d_])+\b", lambda m: re.sub(r"[.\s]", "", m[0]) + " ", _fold(name))
    words = re.findall(r"[^\W_]+", re.sub(r"['’`]", "", name).replace("gesellschaft mbh", "gesellschaftmbh").replace("gesellschaft m b h", "gesellschaftmbh"))
    core = [w for w in words if w not in lexicon.filler_words]
    legal, forms = "", lexicon.legal_forms
    while len(core) > 1 and core[-1] in forms:
        legal = forms[core.pop()]
    if not legal and len(core) > 2:  # the form may stand elsewhere when parts were reordered, or be mistyped
        for w in core:
            near = forms.get(w) if len(w) < 7 else next((f for x, f in forms.items() if len(x) >= 7 and edits(w, x, 1) <= 1), None)
            if near:
                legal = near
                core.remove(w)
                break
    return (*core, f"={legal}") if legal else tuple(core)


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours turns a into b, or none."""
    m, n = len(a), len(b)
    if m > n:
        return one_edit(b, a)
    if n - m > 1:
        return False
    i = next((i for i in range(m) if a[i] != b[i]), m)
    if n > m:
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i + 1 : i + 2] + b[i : i + 1] and a[i + 2 :] == b[i + 2 :]


def edits(a: str, b: str, most: int = 1) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that turn a into b, up to ``most``, else most + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    if most == 1:
        return 1 if one_edit(a, b) else 2
    old, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, old, row = old, row, [i]
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _nickname(a: str, b: str, lexicon: Lexicon) -> bool:
    fa, fb = lexicon.full_forms.get(a, frozenset()), lexicon.full_forms.get(b, frozenset())
    return b in fa or a in fb or bool(fa & fb)


def _abbreviates(a: str, b: str) -> bool:
    """a begins b, or has letters of b in their order, from its first to its last (not counting a plural s)."""
    if not 2 <= len(a) < len(b) or a[0] != b[0]:
        return False
    if b.startswith(a):
        return True
    rest = iter(b)
    return len(a) >= 3 and all(c in rest for c in a) and (a[-1] == b[-1] or b[-1] == "s" and a[-1] == b[-2])


#: Costs of aligned tokens.
SAME, NICK, SHORT, EDIT, INITIAL = 0.0, 0.1, 0.1, 0.3, 0.4


def _person_cost(a: str, b: str, lexicon: Lexicon) -> float | None:
    if a == b:
        return SAME if len(a) > 1 else 0.05
    if len(a) == 1 or len(b) == 1:
        return INITIAL if a[0] == b[0] else None
    if _nickname(a, b, lexicon):
        return NICK
    if min(len(a), len(b)) >= EDITABLE and edits(a, b) <= 1:
        return EDIT
    return None


def _word_cost(a: str, b: str) -> float | None:
    if a == b:
        return SAME
    if _abbreviates(a, b) or _abbreviates(b, a):
        return SHORT
    if min(len(a), len(b)) >= EDITABLE + 1 and edits(a, b) <= 1:
        return EDIT
    return None


def _by_subsets(table: list[list[float | None]]) -> list[tuple[int, int, float]]:
    best: dict[int, tuple[int, float, tuple]] = {0: (0, 0.0, ())}  # by the set of columns taken
    for i, row in enumerate(table):
        nxt = dict(best)
        for taken, (n, total, pairs) in best.items():
            for j, c in enumerate(row):
                if c is not None and not taken >> j & 1:
                    key = taken | 1 << j
                    new = (n + 1, total + c, (*pairs, (i, j, c)))
                    if key not in nxt or (-new[0], new[1]) < (-nxt[key][0], nxt[key][1]):
                        nxt[key] = new
        best = nxt
    return list(min(best.values(), key=lambda v: (-v[0], v[1]))[2])


def _by_paths(table: list[list[float | None]]) -> list[tuple[int, int, float]]:
    """Cheapest augmenting paths, one after the other: the least cost of each number of pairs, up to the greatest."""
    n, m = len(table), len(table[0])
    row_of: list[int | None] = [None] * m
    taken: list[int | None] = [None] * n
    while True:
        reach: list[float] = [0.0 if t is None else float("inf") for t in taken]  # cost of freeing each row
        before: list[int | None] = [None] * m  # the row from which a column was reached
        at = [float("inf")] * m
        for _ in range(n):
            moved = False
            for i in range(n):
                for j in range(m):
                    c = table[i][j]
                    if c is not None and taken[i] != j and reach[i] + c < at[j] - 1e-9:
                        at[j], before[j], moved = reach[i] + c, i, True
                        if (r := row_of[j]) is not None:
                            reach[r] = at[j] - table[r][j]
            if not moved:
                break
        end = min((j for j in range(m) if row_of[j] is None and before[j] is not None), key=lambda j: at[j], default=None)
        if end is None:
            return [(i, j, table[i][j]) for i, j in enumerate(taken) if j is not None]
        j: int | None = end
        while j is not None:
            i = before[j]
            row_of[j], taken[i], j = i, j, taken[i]


def _assigned(table: list[list[float | None]]) -> list[tuple[int, int, float]]:
    return _by_subsets(table) if len(table[0]) <= 8 else _by_paths(table)


def assign(a: tuple[str, ...], b: tuple[str, ...], cost) -> list[tuple[int, int, float]]:
    """The assignment of the tokens of the shorter name that matches most of them at the least cost."""
    if len(a) > len(b):
        return [(j, i, c) for i, j, c in assign(b, a, cost)]
    return _assigned([[cost(x, y) for y in b] for x in a]) if a else []


NO, FITS, SAME_ENTITY = 0, 1, 2


def match_persons(a: tuple[str, ...], b: tuple[str, ...], lexicon: Lexicon = DEFAULT) -> int:
    """SAME_ENTITY: two full names agree; FITS: the surname agrees and initials stand for the given names; else NO."""
    cost = lexicon.cost
    if sum(any(cost(PERSON, x, y) is not None for y in b) for x in a) < 2:
        return NO
    pairs = assign(a, b, lambda x, y: cost(PERSON, x, y))
    full = [(i, j, c) for i, j, c in pairs if len(a[i]) > 1 and len(b[j]) > 1]
    left_a = [x for i, x in enumerate(a) if i not in {p[0] for p in pairs}]
    left_b = [x for j, x in enumerate(b) if j not in {p[1] for p in pairs}]
    if left_a and left_b or any(len(x) > 1 for x in left_a + left_b) and (len(full) < 2 or any(c > NICK for *_, c in full)):
        return NO
    if sum(c == EDIT for *_, c in full) > 2 or not any(max(len(a[i]), len(b[j])) >= INDEXED for i, j, _ in full):
        return NO
    if len(full) >= 2:
        return SAME_ENTITY
    return FITS if len(full) == 1 and len(pairs) >= 2 else NO


@lru_cache(1 << 16)
def _without_legal(tokens: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    return tuple(x for x in tokens if x[0] != "="), tuple(x for x in tokens if x[0] == "=")


def match_organizations(a: tuple[str, ...], b: tuple[str, ...], lexicon: Lexicon = DEFAULT) -> int:
    """SAME_ENTITY if all words agree and the legal forms, where both have one, are the same; else NO."""
    (a, legal_a), (b, legal_b) = _without_legal(a), _without_legal(b)
    if len(a) != len(b) or len(a) < 2 or legal_a and legal_b and legal_a != legal_b:
        return NO
    cost = lexicon.cost
    for x in a:
        for y in b:
            if x == y or cost(ORGANIZATION, x, y) is not None:
                break
        else:
            return NO
    pairs = assign(a, b, lambda x, y: cost(ORGANIZATION, x, y))
    if len(pairs) < len(a) or sum(c == EDIT for *_, c in pairs) > 2:
        return NO
    return SAME_ENTITY if any(c in (SAME, EDIT) and len(a[i]) >= INDEXED for i, _, c in pairs) else NO


def is_full(kind: str, tokens: tuple[str, ...]) -> bool:
    """Whether a name is fit to be compared: a person's has two names written out, an organisation's two words."""
    if kind == PERSON:
        return sum(len(t) > 1 for t in tokens) >= 2
    return sum(t[0] != "=" for t in tokens) >= 2


def _parsed(lexicon: Lexicon):
    """``entity_id, kind, name, state``: state is full, initial (of a person) or bare (one word or an acronym)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for entity, kind, canonical, aliases in zip(*(b.column(c).to_pylist() for c in ("entity_id", "kind", "canonical_name", "aliases"))):
                seen = set()
                for raw in (canonical, *(aliases or ())):
                    tokens = (person_tokens if kind == PERSON else organization_tokens)(raw or "", lexicon)
                    if not tokens or tokens in seen:
                        continue
                    seen.add(tokens)
                    if is_full(kind, tokens):
                        state = "full"
                    else:
                        state = "initial" if kind == PERSON and len(tokens) > 1 and any(len(t) >= INDEXED for t in tokens) else "bare"
                    for column, value in zip(out, (entity, kind, " ".join(sorted(tokens) if kind == ORGANIZATION else tokens), state)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["entity_id", "kind", "name", "state"])

    return run


def deletions(token: str) -> list[str]:
    """The token and what is left of it without any one character."""
    return [token, *{token[:i] + token[i + 1 :] for i in range(len(token))}]


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


@lru_cache(1 << 16)
def _forms(kind: str, token: str, lexicon: Lexicon) -> tuple[tuple[int, bool], ...]:
    """Keys of a token, and whether a key is the token itself: tokens that an edit or a nickname joins have one in common."""
    least = EDITABLE if kind == PERSON else INDEXED
    own = {_hash(kind, v): v == token for v in (deletions(token) if len(token) >= least else [token])}
    if kind == PERSON:
        own = {_hash(kind, f): False for f in lexicon.full_forms.get(token, ())} | own
    return tuple(own.items())


def _short_keys(word: str) -> list[tuple[str, int]]:
    """What a word has in common with its short forms: beginnings (role 1: the short form, 2: the long one), or the first
    and the last letter, not counting a plural s (role 0)."""
    out = [(f"p{word}", 1), *((f"p{word[:k]}", 2) for k in range(2, len(word)))] if len(word) > 1 else []
    if len(word) > 2:
        out.append((f"s{word[0]}{word[-1]}", 0))
        if word[-1] == "s":
            out.append((f"s{word[0]}{word[-2]}", 0))
    return out


def _token_keys(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for kind, token, n in zip(*(b.column(c).to_pylist() for c in ("kind", "token", "n"))):
                for v, own in _forms(kind, token, lexicon):
                    for column, value in zip(out, (v, own, kind, token, n)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64()))], ["v", "own", "kind", "token", "n"])

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


class _Out:
    """Rows gathered into record batches."""

    def __init__(self, **types: pa.DataType):
        self.types, self.columns = types, [[] for _ in types]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, self.types.values())], list(self.types))
        self.columns = [[] for _ in self.types]
        return made

    def full(self, rows: int = 10_000) -> bool:
        return len(self.columns[0]) >= rows


_KEYED = {"kind": pa.string(), "token": pa.string(), "v": pa.int64(), "own": pa.bool_(), "hot": pa.bool_()}


def _shared_keys(bucket: int, lexicon: Lexicon):
    """``kind, token, v, own, hot``: keys that two tokens of one kind have which an edit or a nickname joins, and tokens that
    two names have; hot if the key would make more pairs of names than ``bucket`` names have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(**_KEYED)
        for _, group in groupby(_rows(batches), key=itemgetter(0)):
            rows, joined, pairs = list(group), set(), 0  # tokens that share a deletion: no more than letters and places
            for i, (v, own, kind, x, n) in enumerate(rows):
                pairs += n * (n - 1) // 2 if own else 0
                for j in range(i):
                    y = rows[j][3]
                    if kind == rows[j][2] and (kind == PERSON and _nickname(x, y, lexicon) or edits(x, y) <= 1):
                        joined |= {i, j}
                        pairs += n * rows[j][4]
            for i, (v, own, kind, x, n) in enumerate(rows):
                if i in joined or own and n > 1:
                    out.add(kind, x, v, own, pairs > bucket * (bucket - 1) // 2)
            if out.full():
                yield out.batch()
        yield out.batch()

    return run


#: Rows of the pairing: a key, the name, the places its key is made of and whether they are the token itself, its role (names
#: of role 1, or of role 2, aren't paired with each other), and what the key is made of: v one deletion, d two, i a deletion
#: and an initial, p and s a deletion and a short key, l a deletion and first letters, t two deletions and a third token.
_PLACED = {"key": pa.int64(), "kind": pa.string(), "name": pa.string(), "p": pa.int32(), "q": pa.int32(), "own_p": pa.bool_(), "own_q": pa.bool_(), "role": pa.int32(), "made": pa.string()}
_PLACED_SQL = "key bigint, kind string, name string, p int, q int, own_p boolean, own_q boolean, role int, made string"


def _name_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each name, out of ``kind, name, short, places`` (place, v, own, hot)."""
    out = _Out(**_PLACED)
    for kind, name, short, places in _rows(batches):
        role, hot = int(short), []
        for x in places:
            if x["hot"]:
                hot.append((x["v"], x["place"], x["own"]))
            else:
                out.add(x["v"], kind, name, x["place"], -1, x["own"], True, role, "v")
        if hot:
            tokens = name.split(" ")
            words = [i for i, t in enumerate(tokens) if t[0] != "="]
            if not short:
                hot.sort()
                for i, (w, q, own_q) in enumerate(hot):
                    for v, p, own_p in hot[:i]:
                        if p != q:
                            # An organisation's other words keep their first letters, but for edited ones; of these there are
                            # at most two, so they are p and q of one of the keys.
                            rest = "".join(sorted(tokens[j][0] for j in words if j not in (p, q))) if kind == ORGANIZATION else ""
                            out.add(_hash("d", v, w, rest), kind, name, p, q, own_p, own_q, 0, "d")
            for v, p, own in hot:
                others = [tokens[i] for i in words if i != p]
                if kind == PERSON:
                    for c in {t[0] for t in others if len(t) == 1 or not short}:
                        out.add(_hash("i", v, c), kind, name, p, -1, own, True, 1 if short else 2, "i")
                elif len(others) == 1:
                    q = next(i for i in words if i != p)
                    for k, r in _short_keys(others[0]):
                        out.add(_hash("s", v, k), kind, name, p, q, own, False, r, k[0])
                else:
                    out.add(_hash("l", v, "".join(sorted(t[0] for t in others))), kind, name, p, -1, own, True, 0, "l")
        if out.full():
            yield out.batch()
    yield out.batch()


def _matcher(kind: str, lexicon: Lexicon):
    """How two names align; FITS only counts between a full name and one that isn't."""

    def persons(x: tuple[str, ...], y: tuple[str, ...]) -> int:
        fit = match_persons(x, y, lexicon)
        return fit if fit != FITS or is_full(kind, x) != is_full(kind, y) else NO

    return persons if kind == PERSON else lambda x, y: match_organizations(x, y, lexicon)


def _may_pair(x: tuple, y: tuple, kind: str, made: str, lexicon: Lexicon) -> bool:
    """Whether two rows of one key are to be compared by it: not if another key of theirs brings them together anyway (equal
    tokens have the token itself for a key), nor if the tokens that the key is made of don't go together.

    Rows: name, tokens, p, q, own_p, own_q, role, and the words at other places."""
    if x[0] == y[0] or x[6] and x[6] == y[6]:
        return False
    a, b = x[1][x[2]], y[1][y[2]]
    if a == b and not x[4] or a != b and lexicon.cost(kind, a, b) is None:
        return False
    if made in "dtps":
        a, b = x[1][x[3]], y[1][y[3]]
        if a == b and not x[5] and made not in "ps" or lexicon.cost(kind, a, b) is None:
            return False
    if kind == ORGANIZATION:  # all words must go together
        return len(x[7]) == len(y[7]) and (len(x[7]) != 1 or lexicon.cost(kind, x[7][0], y[7][0]) is not None)
    return True


def _brief(rows: list[tuple]) -> list[tuple]:
    split = ((r, tuple(r[2].split(" "))) for r in rows)
    return [(r[2], t, *r[3:8], tuple(w for i, w in enumerate(t) if i != r[3] and i != r[4] and w[0] != "=")) for r, t in split]


def _in_pairs(rows: list[tuple], kind: str, lexicon: Lexicon) -> Iterator[tuple[tuple, tuple]]:
    """Two rows of a key at a time, whose tokens at the key's place go together."""
    by: dict[str, list[tuple]] = {}
    for r in rows:
        by.setdefault(r[1][r[2]], []).append(r)
    groups = [(t, *([r for r in mine if r[6] == role] for role in (0, 1, 2)), mine[0][4]) for t, mine in by.items()]
    for i, (t, a, b, c, own) in enumerate(groups):
        if own:
            yield from combinations(a, 2)
            yield from product(a, b + c)
            yield from product(b, c)
        for u, x, y, z, _ in groups[:i]:
            if lexicon.cost(kind, t, u) is not None:
                yield from product(a, x + y + z)
                yield from product(b, x + z)
                yield from product(c, x + y)


_FIT = "kind string, a string, b string, fit int"
_FOUND = {"kind": pa.string(), "a": pa.string(), "b": pa.string(), "fit": pa.int32()}


def _paired(most: int, lexicon: Lexicon):
    """Names of one key that align, and the rows of keys of more than ``most`` names as they are; rows come sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(**_FOUND, **{k: t for k, t in _PLACED.items() if k != "kind"})
        for _, group in groupby(_rows(batches), key=itemgetter(0)):
            rows = list(islice(group, most + 1))
            if len(rows) > most and rows[0][8] != "v":
                for r in chain(rows, group):
                    out.add(r[1], None, None, None, r[0], *r[2:])
                    if out.full():
                        yield out.batch()
            elif len(rows) > 1:
                rows += group  # of one deletion there are no more than its pairs
                kind, made = rows[0][1], rows[0][8]
                match = _matcher(kind, lexicon)
                for x, y in _in_pairs(_brief(rows), kind, lexicon):
                    if _may_pair(x, y, kind, made, lexicon) and (fit := match(x[1], y[1])):
                        out.add(kind, min(x[0], y[0]), max(x[0], y[0]), fit, *[None] * 8)
            if out.full():
                yield out.batch()
        yield out.batch()

    return run


def _third_keys(lexicon: Lexicon):
    """Keys of large classes, those of two deletions refined by a third token: of two persons with more than two names, or
    two organisations of more than two words, a third token aligns, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(**_PLACED)
        for key, kind, name, p, q, own_p, own_q, role, made in _rows(batches):
            place = (p, q, own_p, own_q)
            rest = [t for i, t in enumerate(name.split(" ")) if i not in (p, q) and t[0] != "="]
            if made != "d" or kind == ORGANIZATION and not rest:
                out.add(key, kind, name, *place, role, made)
                continue
            if kind == PERSON:
                out.add(_hash(key, "*"), kind, name, *place, 2 if rest else 1, "t")  # those of two names with all others
                if not rest:
                    out.add(_hash(key, "="), kind, name, *place, 0, "t")
            for t in rest:
                for v, _ in _forms(kind, t, lexicon):
                    out.add(_hash(key, v), kind, name, *place, 0, "t")
                out.add(_hash(key, "@", t[0]), kind, name, *place, 0 if kind == ORGANIZATION or len(t) == 1 else 2, "t")
            if out.full():
                yield out.batch()
        yield out.batch()

    return run


def _letters(token: str) -> int:
    mask = 0
    for c in token:
        mask |= 1 << ord(c) % 61
    return mask


def _block_aligned(lexicon: Lexicon):
    """Names of two blocks of one large class that align."""

    def run(t: pa.Table) -> pa.Table:
        out = _Out(**_FOUND)
        kind, made = t.column("kind")[0].as_py(), t.column("made")[0].as_py()
        match = _matcher(kind, lexicon)
        rows = sorted(zip(*(t.column(c).to_pylist() for c in (*_PLACED, "side"))), key=lambda r: r[2])
        brief, side = _brief(rows), np.array([r[9] for r in rows])
        role = np.array([x[6] for x in brief])
        mask = np.array([_letters(x[1][x[3]]) if made == "s" else 0 for x in brief], np.uint64)
        for i, x in enumerate(brief):
            near = (side[:i] != side[i]) | (side[i] == 0)
            near &= (role[:i] != role[i]) | (role[i] == 0)
            if made == "s":  # a short form has no letter that the long one lacks
                both = mask[:i] & mask[i]
                near &= (both == mask[i]) | (both == mask[:i])
            for j in np.flatnonzero(near):
                y = brief[j]
                if _may_pair(x, y, kind, made, lexicon) and (fit := match(x[1], y[1])):
                    out.add(kind, y[0], x[0], fit)
        return pa.Table.from_batches([out.batch()])

    return run


def aligned_names(names: DataFrame, bucket: int = BUCKET, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """``kind, a, b, fit``: of distinct ``kind, name, state``, full names that align (SAME_ENTITY), and full names with those
    of state ``initial`` that stand for them (FITS). The result is the same for every ``bucket``."""
    # Pairing costs time rather than bytes: tasks by number, which are not merged by size.
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = names.select("kind", "name", (F.col("state") == "initial").alias("short")).distinct()
    tokens = written(names.select("*", F.posexplode(F.split("name", " ")).alias("place", "token")).where("token <> '' and not startswith(token, '=') and (length(token) > 1 or kind <> 'PERSON')"), "tokens")
    known = tokens.groupBy("kind", "token").agg(F.count("*").alias("n"))
    keys = known.mapInArrow(_token_keys(lexicon), "v bigint, own boolean, kind string, token string, n bigint")
    keys = keys.repartition(tasks, "v").sortWithinPartitions("v").mapInArrow(_shared_keys(bucket, lexicon), "kind string, token string, v bigint, own boolean, hot boolean")
    keys = written(keys.groupBy("kind", "token").agg(F.collect_list(F.struct("v", "own", "hot")).alias("keys")), "keys")  # one token's deletions
    keyed = tokens.join(keys, ["kind", "token"]).select("kind", "name", "short", F.explode(F.transform("keys", lambda k: F.struct("place", k["v"].alias("v"), k["own"].alias("own"), k["hot"].alias("hot")))).alias("x"))
    placed = keyed.groupBy("kind", "name", "short").agg(F.collect_list("x").alias("places"))  # one name's keys
    rows = placed.mapInArrow(_name_keys, _PLACED_SQL).repartition(tasks, "key").sortWithinPartitions("key")
    found = written(rows.mapInArrow(_paired(LARGE * bucket, lexicon), f"{_FIT}, {_PLACED_SQL.replace('kind string, ', '')}"), "aligned")
    pairs = found.where("fit is not null").select("kind", "a", "b", "fit")
    large = found.where("fit is null").select(*_PLACED)
    if not large.isEmpty():
        each = written(large.mapInArrow(_third_keys(lexicon), _PLACED_SQL), "large")
        count = each.groupBy("key").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
        each = each.join(count, "key").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
        other = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y"))))
        each = each.withColumn("z", other).select(*_PLACED, F.col("z.x").alias("x"), F.col("z.y").alias("y"), F.when(F.col("z.x") == F.col("z.y"), 0).when(F.col("block") == F.col("z.x"), 1).otherwise(2).alias("side"))
        pairs = pairs.unionByName(each.groupBy("key", "x", "y").applyInArrow(_block_aligned(lexicon), _FIT))
    return pairs.distinct()


def entity_groups(entities: DataFrame, bucket: int = BUCKET, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """``entity_id, group_id``: persons and organisations; entities that stand for the same one share a group_id.

    Edge cases: other types, null ids and entities without a name of letters or digits are left out or are alone;
    null, empty and blank aliases are no names; repeated rows of an id count once; a name of one word, or an acronym,
    links nothing by itself; equal names of one type are the same entity; an empty table gives no rows; other columns,
    whatever their names, are not read.
    """
    cur = current_version(entities.select("entity_id", "entity_type", "canonical_name", "aliases", "updated_at", "seq"), "entity_id")
    cur = cur.where(F.col("entity_type").isin(PERSON, ORGANIZATION)).select("entity_id", F.col("entity_type").alias("kind"), "canonical_name", "aliases")
    cur = written(cur, "current")
    names = written(cur.mapInArrow(_parsed(lexicon), "entity_id string, kind string, name string, state string"), "names")
    full = names.where("state = 'full'")
    fits = written(aligned_names(names.where("state <> 'bare'"), bucket, lexicon), "fits")
    node = lambda kind, name: F.concat(F.lit("n:"), F.substring(kind, 1, 1), F.lit(":"), name)
    states = names.where("state = 'initial'").select("kind", F.col("name")).distinct()
    strong = fits.where(F.col("fit") == SAME_ENTITY)
    # Nodes are names: an entity links its first one with its others, and stands where that one stands.
    own = full.select("entity_id", node("kind", "name").alias("node"))
    first = written(own.groupBy("entity_id").agg(F.min("node").alias("node"), F.max("node").alias("last")), "first")
    several = own.join(first.where("node <> last").select("entity_id", F.col("node").alias("a")), "entity_id").where("a <> node").select("a", F.col("node").alias("b"))
    joined = written(components(several.unionByName(strong.select(node("kind", "a").alias("a"), node("kind", "b").alias("b"))).distinct()), "joined")
    of = lambda df: df.join(joined, "node", "left").withColumn("group_id", F.coalesce("component", "node"))
    # Names with initials: the groups that they fit, by alias or by alignment.
    grouped = written(of(first).select("entity_id", "group_id"), "grouped")
    both = fits.select("kind", F.col("a").alias("short"), F.col("b").alias("full")).unionByName(fits.select("kind", F.col("b").alias("short"), F.col("a").alias("full")))
    weak_names = names.where("state = 'initial'")
    loose = weak_names.join(full.select("entity_id").distinct(), "entity_id", "left_anti")
    by_fit = both.join(states.withColumnRenamed("name", "short"), ["kind", "short"]).select(F.col("short").alias("name"), node("kind", "full").alias("node"))
    by_fit = of(by_fit.join(own.select("node").distinct(), "node", "left_semi")).select("name", "group_id")
    by_alias = weak_names.join(grouped, "entity_id").select("name", "group_id")
    known = written(by_fit.unionByName(by_alias).groupBy("name").agg(F.min("group_id").alias("group_id"), F.max("group_id").alias("other")), "known")
    one = known.where("group_id = other").select("name", "group_id")
    placed = loose.join(one, "name").groupBy("entity_id").agg(F.min("group_id").alias("group_id"), F.max("group_id").alias("other")).where("group_id = other").select("entity_id", "group_id")
    placed = written(placed, "placed")
    # Names with initials that fit no full name: equal ones are the same.
    orphans = loose.join(known.select("name"), "name", "left_anti").join(placed, "entity_id", "left_anti").groupBy("entity_id").agg(F.concat(F.lit("i:"), F.min("name")).alias("group_id"))
    some = written(grouped.unionByName(placed).unionByName(orphans), "some")
    rest = cur.select("entity_id").join(some, "entity_id", "left_anti").select("entity_id", F.concat(F.lit("e:"), "entity_id").alias("group_id"))
    return some.unionByName(rest)


def same_entities(entities: DataFrame, bucket: int = BUCKET, expand: int | None = None, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """``entity_id_a, entity_id_b``: every pair of a group. If ``expand`` is given, each entity of a group of more than so
    many is only paired with the one of smallest id."""
    groups = written(entity_groups(entities, bucket, lexicon), "groups")
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"), F.min("entity_id").alias("first")).where("n > 1")
    sized = written(groups.join(sizes, "group_id"), "groups")
    few = sized if expand is None else sized.where(F.col("n") <= expand)
    # A large group is paired block by block: a of block x meets b of block y, x <= y, so no key of the join has many rows.
    last = F.ceil(F.col("n") / _MEMBERS).cast("int") - 1
    block = F.pmod(F.xxhash64("entity_id"), last + 1).cast("int")
    few = few.select("group_id", "entity_id", block.alias("block"), last.alias("last"))
    left = few.select("group_id", F.col("entity_id").alias("a"), F.col("block").alias("x"), F.explode(F.sequence("block", "last")).alias("y"))
    right = few.select("group_id", F.col("entity_id").alias("b"), F.col("block").alias("y"), F.explode(F.sequence(F.lit(0), "block")).alias("x"))
    met = left.join(right, ["group_id", "x", "y"]).where("x < y or a < b")
    pairs = met.select(F.least("a", "b").alias("entity_id_a"), F.greatest("a", "b").alias("entity_id_b"))
    if expand is None:
        return pairs
    star = sized.where(F.col("n") > expand).where("entity_id <> first").select(F.col("first").alias("entity_id_a"), F.col("entity_id").alias("entity_id_b"))
    return pairs.unionByName(star)
