"""Reading HTML with native regex and array functions; no DOM, no row UDF.

Elements to leave out end where a lenient reader ends them: a nested one of the same
name does not end the outer one, and an unclosed one ends with the element around it. Pages
where that needs no stack, nearly all, are read with one regex; for the others
the open elements are followed from tag to tag. What is read from the heading and
title still ends at the first closing tag.
"""

from functools import reduce

from pyspark.sql import Column, functions as F

from jobloom.functions.entities import decode_entities, shown, without_marks
from jobloom.functions.text import BLANK_RUN, bind, collapse, empty_to_null, strip

# Inside of a tag: '>' may occur in a quoted value, but a quote only counts
# right after '=' (so `title=it's` does not swallow the page).
_IN_TAG = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_TAG = rf"<[a-zA-Z/!?]{_IN_TAG}>"
_COMMENT = r"<!--.*?(?:-->|\z)"
# Separates text nodes; never part of page text.
_NODE = "\x01"
# What ends an element's name, so that <nav-item> is not <nav>.
_NAME_END = r"(?=[\s/>])"

# Elements whose content is not markup, those whose text is not shown, those left out of a body
# description on top of them, and those that have no content.
RAW = ["script", "style"]
UNSEEN = ["template", "rt", "rp"]
BOILERPLATE = ["noscript", "header", "footer", "nav"]
VOID = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param",
    "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer",
]


def _element(names: list[str]) -> str:
    """Comment or whole element, so that neither is searched for the other."""
    tags = "|".join(names)
    return rf"(?is){_COMMENT}|<({tags}){_NAME_END}{_IN_TAG}>.*?(?:</\1\s*>|\z)"


def readable(page: Column) -> Column:
    """The page without comments and unseen elements, references decoded. All
    functions below take this form; only JSON-LD is read from the raw page."""
    plain = F.regexp_replace(without_marks(page), _element(RAW), _NODE)
    return decode_entities(bind(plain, lambda p: without(p, UNSEEN)))


def without(page: Column, names: list[str]) -> Column:
    """The page, which has no comments or raw elements any more, without the elements of these names."""
    marks = F.regexp_extract_all(page, F.lit(rf"(?i)</?(?:{'|'.join(names)}){_NAME_END}"), F.lit(0))
    # One after the other, at most with elements of other names inside.
    flat = r"^(?:<(\w+) (?:<(?!\1 )(\w+) </\2 )*</\1 )*$"
    return bind(F.lower(F.array_join(F.transform(marks, lambda m: F.concat(m, F.lit(" "))), "")), lambda order: (
        F.when(order == "", page)
        .when(order.rlike(flat), F.regexp_replace(page, _element(names), _NODE))
        .otherwise(_cut_pairs(page, names))))


def _named(**fields: Column) -> Column:
    """A struct; aliases do not survive several lambdas."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


# Tags between marks while pairs are cut. They begin with the first, those that open an element to leave out with
# the second, and those that change nothing any more with the third.
_BEGIN, _HIDES, _SETTLED, _SHUT = "\x06", "\x07", "\x08", "\x0e"
_ENDS = rf"(?=[\s/>{_SHUT}])"
_REST = rf"[^{_SHUT}]*+{_SHUT}"
_PLAIN = f"[^{_BEGIN}{_HIDES}]*+"
#: Rounds in which pairs are cut; deeper pages follow the stack.
ROUNDS = 4


def _cut_pairs(page: Column, names: list[str]) -> Column:
    """The same page as by `_cut_out`, in passes over its text from the inside out. Each pass takes elements that the stack
    would open and close again with none of the others left open in between; pages on which that does not reach
    all elements to leave out follow the stack."""
    either = "|".join(names)
    other = rf"(?!(?:{either}){_ENDS})[a-zA-Z][^\s/>{_SHUT}]*+"
    closing = rf"{_BEGIN}(/\1{_ENDS}{_REST})"
    # What opens and closes nothing.
    still = rf"(?i){_BEGIN}(?=[!?]|/?(?:{'|'.join(VOID)}){_ENDS}|/(?![a-zA-Z])|[^/{_SHUT}][^{_SHUT}]*(?<=/){_SHUT})"
    # Elements left out, others with nothing but unclosed ones of these, others.
    hidden = (rf"(?i){_HIDES}({either}){_ENDS}{_REST}{_PLAIN}(?:{_HIDES}(?!\1{_ENDS}){_REST}{_PLAIN})*+{closing}",
              f"{_NODE}{_SETTLED}$2")
    unclosed = (rf"(?i){_BEGIN}({other})({_REST}{_PLAIN})(?:{_HIDES}{_REST}{_PLAIN})++{closing}",
                f"{_SETTLED}$1$2{_NODE}{_SETTLED}$3")
    shown_pair = rf"(?i){_BEGIN}({other})({_REST}{_PLAIN}){closing}", f"{_SETTLED}$1$2{_SETTLED}$3"

    def has(text: Column, mark: str) -> Column:
        return F.contains(text, F.lit(mark))

    def passed(pattern: str, put: str):
        return lambda t: F.when(has(t, _HIDES), F.regexp_replace(t, pattern, put)).otherwise(t)

    cut = F.regexp_replace(page, rf"<([a-zA-Z/!?]{_IN_TAG})>", f"{_BEGIN}$1{_SHUT}")
    cut = F.regexp_replace(F.regexp_replace(cut, still, _SETTLED), rf"(?i){_BEGIN}(?=(?:{either}){_ENDS})", _HIDES)
    for step in [hidden, unclosed, hidden, *[shown_pair, unclosed, hidden] * (ROUNDS - 1)]:
        cut = bind(cut, passed(*step))
    marks = reduce(lambda a, b: a | b, [has(page, x) for x in (_BEGIN, _HIDES, _SETTLED, _SHUT)])
    return bind(F.when(~marks, cut), lambda t: F.when(t.isNull() | has(t, _HIDES), _cut_out(page, names)).otherwise(
        F.replace(F.replace(F.replace(t, F.lit(_BEGIN), F.lit("<")), F.lit(_SETTLED), F.lit("<")), F.lit(_SHUT), F.lit(">"))))


def _cut_out(page: Column, names: list[str]) -> Column:
    """As `without`, by the stack of open elements. A closing tag closes the last open element of its
    name and all inside it; one that has none is ignored."""
    return bind(F.regexp_extract_all(page, F.lit(_TAG), F.lit(0)), lambda tags: F.when(F.size(tags) == 0, page).otherwise(
        bind(_named(tags=tags, texts=F.split(page, _TAG, -1), turns=_turns(tags, names)), _shown_parts)))


def _shown_parts(p: Column) -> Column:
    """What stands before the first turn, from the second to the third, and so on."""
    def part(first: Column, end: Column) -> Column:
        return F.array_join(F.zip_with(
            F.slice(p["tags"], first, end - first), F.slice(p["texts"], first + 1, end - first), lambda tag, text: F.concat(tag, text)), "")

    ends = F.concat(F.array(F.lit(1)), p["turns"], F.array(F.size(p["tags"]) + 1))
    return bind(ends, lambda e: F.concat(F.element_at(p["texts"], 1), F.array_join(F.transform(
        F.sequence(F.lit(1), F.floor(F.size(e) / 2).cast("int")),
        lambda k: part(F.element_at(e, 2 * k - 1), F.element_at(e, 2 * k))), _NODE)))


def _open_words(tags: Column, names: list[str]) -> Column:
    """"<name place " for each tag, a place from 1. An element that is shown and has none left inside
    changes nothing, and goes."""
    def word(tag: Column, at: Column) -> Column:
        opened = F.lower(F.regexp_extract(tag, r"^</?[a-zA-Z][^\s/>]*", 0))
        alone = F.endswith(tag, F.lit("/>")) & ~F.startswith(tag, F.lit("</"))
        return F.when(~alone, bind(opened, lambda o: F.when(
            (o != "") & ~o.isin([f"{x}{v}" for x in ("<", "</") for v in VOID]), F.concat(o, F.lit(" "), at.cast("string")))))

    words = F.array_join(F.transform(tags, lambda t, i: word(t, i + 1)), " ")  # a name holds no blank
    empty = rf"(?<![^ ])<(?!(?:{'|'.join(names)}) )([^\s/>]+) [0-9]+ </\1 [0-9]+(?: |\z)"
    for _ in range(4):
        words = F.regexp_replace(words, empty, "")
    return words


def _turns(tags: Column, names: list[str]) -> Column:
    """The tags, from 1, at which what follows ceases to be shown or is shown again."""
    # `open`: the names of the open elements, each between a line break and a tab; `hidden`: how long that
    # text was before the element that is left out, -1 outside of one.
    start = _named(open=F.lit(""), hidden=F.lit(-1), turns=F.array().cast("array<int>"))

    def follow(state: Column, tag: Column) -> Column:
        def opens(mark: Column) -> Column:
            turn = (state["hidden"] < 0) & tag["name"].isin(names)
            return bind(turn, lambda t: _named(
                open=F.concat(state["open"], mark), hidden=F.when(t, F.length(state["open"])).otherwise(state["hidden"]),
                turns=F.when(t, F.array_append(state["turns"], tag["at"])).otherwise(state["turns"])))

        def closes(mark: Column) -> Column:
            left = F.length(state["open"]) - F.length(F.call_function("substring_index", state["open"], mark, F.lit(-1))) - F.length(mark)
            return bind(left, lambda n: bind(n <= state["hidden"], lambda t: _named(
                open=F.left(state["open"], n), hidden=F.when(t, F.lit(-1)).otherwise(state["hidden"]),
                turns=F.when(t, F.array_append(state["turns"], tag["at"])).otherwise(state["turns"]))))

        return bind(F.concat(F.lit("\n"), tag["name"], F.lit("\t")), lambda mark: F.when(~tag["closes"], opens(mark)).when(
            F.contains(state["open"], mark), closes(mark)).otherwise(state))

    read = F.transform(F.regexp_extract_all(_open_words(tags, names), F.lit("<[^ ]+ [0-9]+"), F.lit(0)), lambda w: _named(
        name=F.regexp_extract(w, "^</?([^ ]+)", 1), closes=F.startswith(w, F.lit("</")),
        at=F.substring_index(w, " ", -1).cast("int")))
    return F.aggregate(read, start, follow)["turns"]


def text_nodes(fragment: Column) -> Column:
    """Stripped, non-empty text nodes in document order."""
    joined = shown(F.regexp_replace(fragment, rf"(?:{_TAG})+", _NODE))
    return F.filter(F.transform(F.split(joined, _NODE), strip), lambda n: n != "")


def text_lines(nodes: Column) -> Column:
    """Nodes with inner blank runs collapsed; none can become empty."""
    return F.transform(nodes, lambda n: F.regexp_replace(n, BLANK_RUN, " "))


def inner(fragment: Column, name: str) -> Column:
    """Content of the first such element; NULL when there is none."""
    pattern = rf"(?is)<{name}{_NAME_END}{_IN_TAG}>(.*?)(?:</{name}\s*>|\z)"
    return bind(F.regexp_extract(fragment, pattern, 0), lambda e: F.when(e != "", F.regexp_extract(e, pattern, 1)))


def first_text(fragment: Column, name: str) -> tuple[Column, Column]:
    """(element present, its collapsed text or NULL)."""
    present = fragment.rlike(rf"(?is)<{name}{_NAME_END}{_IN_TAG}>")
    text = F.array_join(text_nodes(inner(fragment, name)), " ")
    return present, bind(text, collapse)


def body_text(page: Column) -> Column:
    """Text of the body without boilerplate, or of everything when there is no
    body."""
    content = bind(without(page, BOILERPLATE), lambda p: F.coalesce(inner(p, "body"), p))
    return F.array_join(text_nodes(content), " ")


def _attribute(tag: Column, name: str) -> Column:
    """Attribute value; '' when absent."""
    found = rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    return bind(F.regexp_extract(tag, found, 1), lambda v: F.when(
        F.substr(v, F.lit(1), F.lit(1)).isin('"', "'"), F.substr(v, F.lit(2), F.length(v) - 2)
    ).otherwise(v))


def meta_tags(page: Column) -> Column:
    """array<struct<property, name, content>> of the page's meta tags."""
    tags = F.regexp_extract_all(page, F.lit(rf"(?i)<meta{_NAME_END}{_IN_TAG}>"), F.lit(0))
    return F.transform(tags, lambda t: F.struct(
        _attribute(t, "property").alias("property"),
        _attribute(t, "name").alias("name"),
        shown(_attribute(t, "content")).alias("content"),
    ))


def meta_content(metas: Column, key: str) -> Column:
    """Content of the first tag whose property is `key`, else whose name is;
    empty content is NULL, without trying the other attribute."""
    by_property = F.filter(metas, lambda m: m["property"] == key)
    by_name = F.filter(metas, lambda m: m["name"] == key)
    tag = F.coalesce(
        F.try_element_at(by_property, F.lit(1)), F.try_element_at(by_name, F.lit(1)))
    return empty_to_null(tag["content"])


def json_ld_blocks(page: Column) -> Column:
    """Bodies of the ld+json scripts, in document order."""
    scripts = F.filter(
        F.regexp_extract_all(page, F.lit(_element([*RAW, *UNSEEN])), F.lit(0)),
        lambda e: e.rlike(rf"(?i)^<script{_NAME_END}"),
    )
    typed = F.filter(
        scripts,
        lambda s: _attribute(F.regexp_extract(s, rf"(?i)^<script{_NAME_END}{_IN_TAG}>", 0), "type")
        == "application/ld+json",
    )
    return F.transform(typed, lambda s: F.regexp_extract(
        s, rf"(?is)^<script{_NAME_END}{_IN_TAG}>(.*?)(?:</script\s*>)?$", 1))


def job_posting(page: Column) -> Column:
    """First JobPosting object (VARIANT) at the top level of a block or of its
    top-level list; blocks that are not JSON are skipped."""
    items = F.flatten(F.transform(json_ld_blocks(page), _as_items))
    postings = F.filter(
        items, lambda i: F.try_variant_get(i, "$['@type']", "string") == "JobPosting")
    return F.when(
        F.contains(page, F.lit("ld+json")), F.try_element_at(postings, F.lit(1)))


def _as_items(block: Column) -> Column:
    return bind(F.try_parse_json(block), lambda value: F.coalesce(
        F.try_variant_get(value, "$", "array<variant>"),
        F.when(value.isNotNull(), F.array(value)),
        F.array().cast("array<variant>"),
    ))
