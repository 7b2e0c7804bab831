"""Documents that are template residue, filler, error pages or script notices.

Look-alike letters and character references are resolved first. Placeholders are found
by one grammar for each delimiter, outside code: fenced blocks and backticked spans are
blanked, and a marker does not count if its sentence is dense with words about templates
or quotes it and has such a word, or if the text explains the same marker elsewhere.
Filler, errors and notices are judged by density: page furniture aside, every sentence
has to consist of words of such messages, spelled right or one edit off (of fixed phrases
in scripts without spaces), and the whole needs an anchor that real text would not
consist of. Real content that quotes or reports a message has sentences of other words.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.arrowmap import map_batches
from ..session import spread
from .lookalike import transducer

# Words that name a slot of a template.
SLOTS = frozenset(
    "abstract account address age amount article author birthday body brand browser button caption category city client code color "
    "comment company contact content context count country currency customer date day deadline department description district "
    "document due email end event example field file first firstname full gender greeting header headline hour id image industry "
    "input institution invoice item job key keyword label language last lastname link location logo message middle model month name "
    "nickname note number object order organisation organization output page paragraph password payment phone photo place position "
    "postcode price product project property prompt quantity query question reason receiver recipient reference region reply report response "
    "result role salary score sender sentence sentiment service shop signature size sku start state status street subject summary "
    "surname table tag team telephone text time title token topic total tracking type unit url user username value variable "
    "website week word year zip".split()
)
# Words that ask for a slot to be filled, before or around its name.
ASKS = frozenset("your enter insert add type fill put choose select here hier ici aqui einfugen eingeben eintragen ihr ihre votre inserer saisir su introduzca escriba inserte ваш введите the a an".split())
# Double-underscored names of a programming language.
DUNDERS = frozenset("init main file all doc dict class str repr len call new del iter next enter exit eq hash slots path version".split())

_W = r"[\p{L}][\p{L}\d]*"
_NAME = rf"{_W}(?:[ _.\-]{_W}|[_.\-]?\d+){{0,5}}"
_CODE = regex.compile(r"```.*?(?:```|\Z)|``[^`]*``|`[^`\n]*`|<(?:code|pre)\b.*?</(?:code|pre)>", regex.S | regex.I)
#: Delimiters that occur in templates only: any name inside is a placeholder.
_SURE = regex.compile(
    rf"\{{\{{[#/^>!&~]?\s*{_NAME}(?:\s*\|\s*[\w: ]+)*\s*\}}\}}"
    rf"|\{{%-?\s*{_NAME}(?:\s[^%]{{0,60}})?\s*-?%\}}"
    rf"|<%[=-]?\s*@?{_NAME}(?:[\[(][^%]{{0,60}})?\s*-?%>"
    rf"|[#$]\{{\s*{_NAME}\s*\}}"
    rf"|%\({_NAME}\)[sdif]"
    rf"|\*\|\s*{_NAME}\s*\|\*"
    rf"|(?<!#)##{_NAME}##(?!#)"
    rf"|<<\s*{_NAME}\s*>>"
    rf"|(?<![\w@])@@\s*{_NAME}\s*@@(?![\w@])"
    rf"|(?<=[\p{{Lu}}]\p{{L}}{{1,14}} )%s(?=[,.:;!? ]|$)"
    rf"|\{{\d\}}",
    regex.I,
)
#: Delimiters with other uses: the name has to be a slot's.
_MAYBE = regex.compile(
    rf"(?<d>\[\[)\s*(?<n>{_NAME})\s*\]\]|(?<d>\[)\s*(?<n>{_NAME})\s*\]|(?<d>\{{)\s*(?<n>{_NAME})\s*\}}|(?<d><)\s*(?<n>{_NAME})\s*>"
    rf"|(?<d>«)\s*(?<n>{_NAME})\s*»|(?<![\w%])(?<d>%)%?(?<n>{_W}(?:[_.]{_W})*)%(?!\w)|(?<![\w$])(?<d>\$)(?<n>{_W}(?:[_.]{_W})*)\$(?!\w)"
    rf"|(?<![\w])(?<d>__)(?<n>{_W}(?:_{_W})*)__(?!\w)|(?<![\w@])(?<d>@)(?<n>{_W}(?:[_.]{_W})*)@(?!\w)"
    rf"|(?<d>\()\s*(?<n>(?i:insert|enter|type|fill in|put|your)\s{_NAME})\s*\)"
)
_QUOTED = regex.compile(r"[\"'“‘„]\s*$")
_TALK = regex.compile(r"\b(?:placeholder|marker|variable|syntax|notation|written as|write|stands for|called|literal|tutorial|guide|handbook|lecture|course)", regex.I)
#: Words about templates; two of them in its sentence explain a marker.
_ABOUT = regex.compile(r"\b(?:(placeholder)|(marker)|(variable)|(syntax|notation)|(templat\w* engine|templating|mustache|jinja|handlebars)|(tutorial)|(writ(?:e|es|ing|ten))|(stands? for)|(replac(?:e|es|ed|ing))|(delimiter|braces|brackets)|(render)|(literal)|(escap(?:e|ed|ing)))", regex.I)
_BREAK = regex.compile(r"[.!?;]\s|\n")


#: What any placeholder has; one test of the text before the grammars.
_HINT = re.compile(r"[{\[<«]|%[\w(%]|[$#]\{|\$\w|__|##|@@|@\w|\*\||\((?:insert|enter|type|fill in|put|your)\s", re.I)
#: Other forms of the characters in it.
_HINT_FORMS = re.compile("[｛［＜％＄＿＃＊＠（]|&(?:lt|gt|quot|amp|#)")


def _sentence(text: str, start: int, end: int) -> str:
    """The sentence around a span, without the span."""
    head, tail = text[max(0, start - 400) : start], text[end : end + 400]
    cut = [m.end() for m in _BREAK.finditer(head)]
    stop = _BREAK.search(tail)
    return head[cut[-1] if cut else 0 :] + " " + (tail[: stop.start()] if stop else tail)


def _fold(text: str) -> str:
    low = text.lower()
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


def _is_slot(delimiter: str, name: str) -> bool:
    words = [w for w in regex.split(r"[ _.\-]+|(?<=\p{Ll})(?=\p{Lu})", name) if w]
    low = [_fold(w) for w in words]
    if delimiter == "__" and low[0] in DUNDERS:
        return False
    core = [w for w in low if w not in ASKS and not w.isdigit()]
    if not core:
        return False
    known = sum(near(w, _SLOT_NEAR) for w in core)
    return known == len(core) or (known >= 1 and (len(core) < len(low) or "_" in name or len(core) <= 2 and name.isupper()))


def has_placeholder(text: str) -> bool:
    """Whether a placeholder is left in the text, outside code and explanations of it."""
    if not _HINT.search(text):
        return False
    code: list[str] = []
    text = _CODE.sub(lambda m: code.append(m.group()) or " ", text)
    told: list[tuple[int, int]] = []
    explained: set[str] = set()
    left: list[str] = []
    for found in (*_SURE.finditer(text), *_MAYBE.finditer(text)):
        if any(a <= found.start() and found.end() <= b for a, b in told):
            continue
        if found.re is _MAYBE and not _is_slot(found.group("d"), found.group("n")):
            continue
        if found.group().startswith("<") and f"</{found.group()[1:-1].strip().lower()}" in text.lower():
            continue  # an element of markup that is closed again
        before, after = text[max(0, found.start() - 120) : found.start()], text[found.end() : found.end() + 80]
        quoted = _QUOTED.search(before) and after[:1] in "\"'”’“" and _TALK.search(before + " " + after)
        about = _ABOUT.finditer(_sentence(text, *found.span()))
        if quoted or len({m.lastindex for m in about}) > 1:
            told.append(found.span())
            explained.add(found.group())
        else:
            left.append(found.group())
    # A text about templates may use a marker bare that it explains or shows as code.
    if left and (explained or (code and _ABOUT.search(text))):
        shown = " ".join(code)
        left = [x for x in left if x not in explained and x not in shown]
    return bool(left)


# Words of default, dummy and keyboard text.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui "
    "officia deserunt mollit anim id est laborum".split()
)
FILLER = frozenset(
    "asdf asdfg jkl qwerty qwertz foo bar baz qux blah bla test testing xxx xxxx xxxxx text texts todo tbd fixme write abstract default edit me "
    "heading subheading title goes here content coming soon sample dummy placeholder paragraph replaced replace before publishing type your "
    "description provided no later more will be filler example add insert caption summary section "
    "texto ejemplo escriba aqui su contenido relleno texte remplissage completer exemple hier steht spater richtige der blindtext bitte ersetzen "
    "platzhalter mustertext beispieltext folgt inhalt testo segnaposto пример текста заполнитель текст здесь будет".split()
)
ERRORS = frozenset(
    "error errors err code status http https detail message id request requests ref reference ray fetch failed failure fatal exception traceback most recent call last "
    "file line load py timeouterror read timed timeout out connection connect refused reset database could not found page pages available unavailable temporarily "
    "temporary service server internal bad gateway forbidden unauthorized unauthorised gone too many rate limit reached exceeded unknown "
    "conflict payload large method allowed acceptable precondition implemented access denied do have has been permission permissions view "
    "document removed deleted moved requested address exists longer no unable complete your was were is are session expired log login "
    "again please try later slow down retry after seconds minutes whoops oops sorry something went wrong blocked checking that robot human captcha "
    "verify cannot be shown right now asked url site under maintenance html body head title web nginx apache proxy "
    "name resolved dns probe certificate cert authority invalid ssl empty response redirects aborted closed address changed unreachable internet "
    "non trovata nao encontrada pagina inexistente "
    "page introuvable erreur serveur acces refuse interdit indisponible pagina encontrada encontrado pudo cargar se la no fehler seite nicht gefunden angeforderte "
    "adresse existiert mehr zugriff verweigert die страница не найдена ошибка доступ запрещен сервер недоступен".split()
)
NOTICES = frozenset(
    "javascript scripts script js cookies cookie browser enable enabled disabled activate activated turn turned on off allow allowed require "
    "requires required must need needs to run app page site form reload refresh continue view support supports does switched some functions features "
    "will work please you your this before go use using website content display properly noscript "
    "bitte aktivieren sie um diese seite zu nutzen veuillez activer pour afficher ce contenu active para continuar habilite habilitar navegador "
    "включите чтобы продолжить браузер файлы".split()
)
_GLUE = frozenset("the a an of or and in to for it them we i this that by at as from with on is was be has have not or their les le el los das den de del di du y et un une".split())
_ANCHOR = regex.compile(
    r"(?P<s>javascript|scripts?\b|cookies?\b)|(?P<e>\b[45]\d\d\b|error|fehler|erreur|ошибка|not found|не найдена|denied|forbidden|unauthori[sz]ed|unavailable|introuvable|timed? ?out|timeout|"
    r"gateway|too many requests|traceback|refused|went wrong|expired|blocked|no se pudo|no encontrad|non trovata|nao encontrada|nicht gefunden|failed|rate limit|internal server|\bgone\b|bad request|cannot be shown|removed|maintenance)"
    r"|(?P<f>lorem|ipsum|dolor|adipiscing|asdf|qwert|\bfoo\b|\bblah\b|\btest test\b|x{4,}|text text|goes here|coming soon|placeholder|todo|edit me|"
    r"description|ejemplo|escriba|remplissage|blindtext|richtige text|replace this|sample|dummy)"
)
_FURNITURE = regex.compile(
    r"(?im)^\s*(?:skip to (?:main )?content|back to (?:start|top)|menu|home|login|help|home(?: \| \w+)+|(?:\(c\)|©)[^\n]{0,40}|cookies? policy|privacy|imprint|search|share|next|previous|\d+)\s*$"
    r"|<!--.*?-->|</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>|&(?:[a-z]+|#\d+);"
)
_REFS = regex.compile(r"\b[a-z-]+/\d[\d.]*|\b(?=[0-9a-z]*\d)[0-9a-z]{6,}\b|\b\d+(?:\.\d+)*\b|(?<=/)\d[\d.]*", regex.I)
_SENTENCE = regex.compile(r"(?<=[.!?;:…])\s+|(?<=[。！？])|\n+")
_TOKEN = regex.compile(r"\p{L}+")
# Messages of scripts that are not matched word by word, as error, notice, filler.
PHRASES = {
    "e": "ページが見つかりません お探しのページは見つかりません でした エラーが発生しました アクセスが拒否されました サーバーエラー ただいまメンテナンス中です しばらくしてからもう一度お試しください "
    "找不到页面 页面不存在 页面未找到 您访问的页面不存在 服务器错误 服务器内部错误 访问被拒绝 拒绝访问 出错了 请稍后再试 请求超时 网站维护中 找不到網頁 頁面不存在 伺服器錯誤 拒絕存取 "
    "페이지를 찾을 수 없습니다 오류가 발생했습니다 접근이 거부되었습니다 잠시 후 다시 시도해 주세요 서버 오류 الصفحة غير موجودة لم يتم العثور على الصفحة حدث خطأ تم رفض الوصول خطأ في الخادم",
    "s": "を有効にしてください このページを表示するには このサイトを利用するには スクリプトを有効にしてください クッキーを有効にしてください 请启用 请在浏览器中启用 才能继续 以继续 以查看此页面 請啟用 "
    "을 활성화해 주세요 이 페이지를 보려면 يرجى تفعيل لعرض هذه الصفحة للمتابعة",
    "f": "ここにテキストを入力 ここにテキストが入ります ダミーテキスト サンプルテキスト テキストテキスト 这里是示例文本 在此输入文字 示例文本 占位符文本 此处填写内容 여기에 텍스트를 입력하세요 샘플 텍스트 نص تجريبي اكتب هنا",
}
_WIDE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Arabic}ー"
_PHRASE = regex.compile("|".join(rf"(?P<{k}>{'|'.join(sorted(map(regex.escape, _fold(v).split()), key=len, reverse=True))})" for k, v in PHRASES.items()))
_WIDE_RUN = regex.compile(rf"[{_WIDE}]")


def _deletes(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def _neighbourhood(words: frozenset[str]) -> tuple[frozenset[str], frozenset[str]]:
    """The words and, of those of four letters or more, their one-letter deletions."""
    return words, frozenset(d for w in words if len(w) >= 4 for d in _deletes(w))


_SLOT_NEAR = _neighbourhood(SLOTS)
_SPEECH = [_neighbourhood(x) for x in (LOREM, FILLER, ERRORS, NOTICES)]


def near(word: str, book: tuple[frozenset[str], frozenset[str]]) -> bool:
    """In the book, or, from four letters, an insertion, deletion, substitution or swap away."""
    return word in book[0] or (len(word) >= 4 and not book[1].isdisjoint(_deletes(word)))


@lru_cache(maxsize=200_000)
def _speech(word: str) -> int:
    """Bit i: word of speech i. Glue words belong to all. Look-alike letters of a word that is
    of none are resolved."""
    if word in _GLUE:
        return 15
    found = sum(1 << i for i, book in enumerate(_SPEECH) if near(word, book))
    if not found and not word.isascii() and (form := transducer().apply(word)) != word:
        return _speech(form)
    return found


def _plain(line: str) -> list[str]:
    """Sentences of a line without furniture and references, folded."""
    bare = _REFS.sub(lambda m: m.group() if len(m.group()) == 3 and m.group().isdigit() else " ", _FURNITURE.sub(" ", line))
    return _SENTENCE.split(_fold(bare).replace("_", " "))


def _judged(sentence: str) -> tuple[str, int, int, int, list[str], bool]:
    """(sentence, words, words of messages, glue words, anchors, it is content)."""
    anchors: list[str] = []
    if _WIDE_RUN.search(sentence):  # a phrase is a word; other letters of such scripts are words of two
        anchors = [m.lastgroup for m in _PHRASE.finditer(sentence)]
        sentence = _PHRASE.sub(" ", sentence)
        strange = -(-len(_WIDE_RUN.findall(sentence)) // 2)
        sentence = _WIDE_RUN.sub(" ", sentence) + " ※" * strange
    words = _TOKEN.findall(sentence) + ["※"] * sentence.count("※")
    bits = [_speech(w) for w in words] + [14] * len(anchors)
    strange, n = bits.count(0), len(bits)
    return sentence, n, n - strange, bits.count(15), anchors, strange > max(1 if n > 2 else 0, 0.2 * n)


def _opens_with_content(line: str) -> bool:
    """Whether one of the first whole sentences of a long line is content; markup that such a
    part may cut is left to the whole line."""
    head = line[:400]
    ends = [m.end() for m in _SENTENCE.finditer(head)]
    if not ends or "<!--" in head or "<" in head and head.rfind("<", 0, ends[-1]) > head.rfind(">", 0, ends[-1]):
        return False
    return any(_judged(x)[-1] for x in _plain(head[: ends[-1]]))


def is_no_content(text: str) -> bool:
    """Whether the text, page furniture aside, is filler, an error or a notice. A sentence of
    other words is content, whatever surrounds it."""
    total = good = glue = 0
    seen: list[str] = []
    anchors: set[str] = set()
    for line in text.split("\n"):
        if len(line) > 600 and _opens_with_content(line):
            return False
        for each in _plain(line):
            sentence, n, hits, joints, found, content = _judged(each)
            if content:
                return False
            seen.append(sentence)
            anchors.update(found)
            total += n
            good += hits
            glue += joints
    if not total or good < 0.85 * total or glue > 0.65 * total:
        return False
    folded = " ".join(seen)
    if not folded.isascii():
        folded += " " + transducer().apply(folded)
    return bool(anchors) or bool(_ANCHOR.search(folded)) or _anchored(folded)


def _anchored(folded: str) -> bool:
    """An anchor word within one edit."""
    return any(len(w) >= 5 and near(w, _ANCHOR_NEAR) for w in _TOKEN.findall(folded))


_ANCHOR_NEAR = _neighbourhood(
    frozenset(
        "javascript scripts cookies error fehler erreur ошибка denied forbidden unauthorized unavailable introuvable timeout gateway traceback refused expired "
        "blocked failed removed lorem ipsum dolor adipiscing placeholder description ejemplo escriba remplissage blindtext qwerty sample".split()
    )
)


def is_residue(text: str | None) -> bool:
    """Null, empty and blank texts are none."""
    if not text or text.isspace():
        return False
    if "&" in text:
        text = html.unescape(text)
    if is_no_content(text) or has_placeholder(text):
        return True
    # Delimiters and names may be look-alikes: once more with those resolved.
    if text.isascii() or not (_HINT.search(text) or _HINT_FORMS.search(text)):
        return False
    form = transducer().apply(text)
    return form != text and has_placeholder(form)


def flag_residue(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``residue`` (boolean, false for null and blank texts), a row for each input row."""
    kind = dict(docs.dtypes)[key]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            flags = pa.array(map(is_residue, batch.column(1).to_pylist()), pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column(0), flags], ["key", "residue"])

        return step

    rows = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return map_batches(rows, f"key {kind}, residue boolean", make).withColumnRenamed("key", key)


def residue_ids(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct keys of the documents to keep out of the corpus."""
    kind = dict(docs.dtypes)[key]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            flags = pa.array(map(is_residue, batch.column(1).to_pylist()), pa.bool_())
            return pa.RecordBatch.from_arrays([pc.filter(batch.column(0), flags)], ["key"])

        return step

    rows = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length(F.trim("text")) > 0))
    return map_batches(rows, f"key {kind}", make).distinct().withColumnRenamed("key", key)


def clean_corpus(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without residue, read once and not moved; all columns and repeated rows,
    null and blank texts included. Each row is judged by its own text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index(text)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pc.invert(pa.array(map(is_residue, batch.column(at).to_pylist()), pa.bool_())))

        return step

    return map_batches(spread(docs), schema, make)
