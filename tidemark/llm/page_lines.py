"""What the form of a page's line tells: its kind, what it would weigh as markup, and the hash it recurs by.

Used by the operators for template residue (problem 2) and page boilerplate (problem 3). The word lists here are
short and only hint: a hinted line counts as a link if it also recurs (see recurrence), a plain one if it recurs
more often. Rules that decide alone are rules of form: crumbs, by-lines, tags, leads such as 'Read also: X',
placeholders, filler and what programs write when they fail.
"""

from __future__ import annotations

import re

import xxhash

# Words of menus and footers in the five languages of the data.
MENU_WORDS = frozenset(
    "home|news|press|events|shop|help|links|gallery|services|members|downloads|projects|archive|contacts|contact|about us|about|site map|sitemap|search|login|"
    "startseite|neues|presse|termine|hilfe|verweise|galerie|leistungen|archiv|kontakt|über uns|aktuelles|suche|"
    "accueil|actualités|agenda|aide|liens|archives|à propos|recherche|"
    "inicio|noticias|prensa|ayuda|enlaces|galería|servicios|archivo|contacto|quiénes somos|buscar|"
    "главная|новости|пресса|события|помощь|ссылки|галерея|услуги|архив|контакты|о нас|поиск".split("|")
)
# Headings over links to other stories, and leads of such a link within the text.
RELATED_HEADS = re.compile(
    r"(most read|related stories|you may also like|more on this topic|read more|latest from .+|more from .+|"
    r"meistgelesen|das könnte sie auch interessieren|mehr von .+|mehr zum thema|"
    r"les plus lus|à lire aussi|encore sur .+|sur le même sujet|lo más leído|también le puede interesar|más de .+|sobre el mismo tema|"
    r"самое читаемое|читайте также|ещё на сайте .+|по теме)"
)
RELATED_INLINE = re.compile(r"(more|see also|read also|read more|related|mehr dazu|lesen sie auch|siehe auch|lire aussi|voir aussi|à lire aussi|lea también|vea también|ver también|читайте также|см\. также|по теме)\s*:\s*\S")
# Openings of by-lines, tag lines and letter prompts.
META = re.compile(
    r"(by|posted by|written by|von|verfasst von|autor|autora|par|publié par|por|publicado por|автор|опубликовал|опубликовала|author)\b:?\s+(?=\S)(?!.*[.!?]$).{1,80}|"
    r"[^.!?:]{3,60} - \d{1,2}\.\d{1,2}\.\d{4} - [\d.,]+ \w+|"
    r"(tags|schlagworte|mots-clés|etiquetas|метки|теги|ключевые слова|keywords|filed under)\s*:.*|"
    r"subscribe to .*newsletter.*"
)
# Words that furniture holds more often than articles do; they lower the count a line must recur by.
HINTS = (
    "cookie", "куки", "newsletter", "рассылк", "reciba el boletín", "noticias de", "nouvelles de", "lettre de", "neues von", " bestellen ", "каждую неделю",
    "small files", "kleine dateien", "petits fichiers", "ficheros pequeños", "малые файлы",
    "rights reserved", "rechte vorbehalten", "droits réservés", "derechos reservados", "права защищены", "copyright", "©", "powered by",
    "haftet", "haftung", "gewähr", "garantie", "guarantee", "liabil", "responsa", "answerable", "ответственн", "nachdruck", "written leave", "genehmigung", "reproduction", "l'accord", "prohibida", "перепечатка",
    "imprint", "impressum", "datenschutz", "mentions légales", "confidentialité", "plan du site", "privacy", "terms of use", "aviso legal", "privacidad", "mapa del sitio", "правила",
    "share this", "tweet", "teilen", "partager", "compartir", "поделиться", "weitersagen", "a friend", "à un ami", "un amigo", "друзьям", "pass it on",
    " updated", "geändert", " stand ", "mis à jour", "actualizado", "обновлен", " viewed", " views", "aufrufe", " vu ", " vue ", "visitas", "просмотр", " to top", "nach oben", "haut de page", "volver arriba", "наверх", "telefon", "opening hours", "öffnungszeiten",
)
# Words by which a line may be a message.
MESSAGE_HINTS = (
    "javascript", "noscript", " script", "not found", "suspended", "under construction", " error", " fehler", " erreur", "ошибка", "denied", "forbidden", "unavailable", "timeout", "недоступ", "introuvable", "gefunden", "encontrad", " exist", "gibt es nicht", "удалена", "deleted",
    "no copy", "leave to open", "permission", " wrong", " sorry", " oops", " whoops", "bad request", " gone ", "placeholder", "coming soon", "try again", "captcha", " blocked", " parked", "your browser", "your request",
)
# Numbered errors and what programs and databases write when they fail.
FAILURES = re.compile(
    r"#? ?- ?page not found|(http )?(error|fehler|erreur|ошибка)( code)? ?#.*|(http )?# (internal (server )?(error|failure)|gone|not found|service unavailable|forbidden|bad gateway)|(server error|serverfehler|erreur (du )?serveur|error del servidor|ошибка сервера)|"
    r"((page )?not found|gone|forbidden|unauthorized|bad request|(gateway )?timeout|bad gateway|service unavailable|access denied)( \(\S*\))?|"
    r"traceback \(most recent call last\).*|(uncaught |unhandled )?exception.*|(fatal|parse|database|runtime|syntax) error\b.*|warning: \S+ .*|\[odbc[^\]]*\].*|ora-#.*|java¶.*|java\.\S*(exception|error)\b.*|segmentation fault.*|(microsoft )?(ole|jet) db .*|notice: undefined .*|"
    r"server error in .{1,60} application.*|noscript: .*|checking your browser\b.*|the server could not \w+ your request.*|please try again later\b.{0,60}|please contact the (operator|administrator|webmaster).{0,40}"
)
PLACEHOLDER = re.compile(
    r"\{\{[^{}]{0,60}\}\}|\$\{[^{}]{0,60}\}|\{%[^%]{0,60}%\}|\{[a-z_0-9]{1,40}\}|<%=?[^%]{0,60}%>|<\?php[^?]{0,80}\?>|%%[a-z_0-9]+%%|%[a-z_]+%|\$[a-z_]+\$|\[\[[^\[\]]{0,60}\]\]|"
    r"\[insert [^\[\]]{1,40}\]|\[[a-z]+_?[a-z_]*\]|#[a-z]+_?[a-z_]*#|@model\.[a-z_]+|__[a-z]+(?:_[a-z]+)*__|«[a-z_]+»: ?todo|<[a-z_]+ goes here>|&lt;[a-z_]+&gt;"
)
# Filler phrases.
FILLER = re.compile(
    r"(lorem ipsum|dummy text|blindtext|sample text goes here|text text text|texto de relleno|texte de remplissage|hier steht später ein text|здесь будет текст|текст[- ]рыба|рыба[- ]текст|headline goes here|your (content|text) here|"
    r"insert (paragraph|text) here|add a short description of this item|type something about your company|asdf(?: asdf)*|blah(?: blah)*|x{4,}(?: x{4,})*|click here to edit|new page|untitled( document)?)\b[.!]?"
)
FUNCTION_WORD = re.compile(
    r"\b(the|a|an|and|of|in|on|at|is|was|were|are|to|for|by|that|with|from|it|der|die|das|und|von|im|ist|wurde|für|den|le|la|les|des|du|et|est|un|une|dans|sur|que|el|los|las|en|de|del|fue|por|con|una|и|в|на|с|по|из|не|был|была|для|при|ко)\b"
)
PLACEHOLDER_SIGN = re.compile(r"[{}<%$\[#@_«&]")
OPENING, CLOSING = "»›>•·* \t\xa0", "«‹< \t\xa0"
ADDRESS, MAIL = re.compile(r"https?://\S+|(?<!\S)/[\w./%~-]+"), re.compile(r"\S+@\S+\.\w+")
INNER_DOT = re.compile(r"\.\w")
REFERENCE = re.compile(r"\s*\((?:ref|id|code|nr|no)\.? [^()]{1,60}\)")
NUMBER = re.compile(r"\d[\d.,:/-]*")
#: Names in messages: quoted ones, single words in brackets, calls and dotted identifiers.
NAMED = re.compile(r"'[^']{1,60}'|\"[^\"]{1,60}\"|(?<=\()[^\s()]{1,60}(?=\))|\b[\w]+(?:\.\w+)+(?:\(\))?|\b\w+\(\)")
REPEATED = re.compile(r"(.{3,80}?)[.!?]?(?: \1[.!?]?)+")
WORD = re.compile(r"[^\W\d_]+")
LONG_TITLE = 12  # words from which a line without a full stop counts as text
#: Words from which a line without full stop can be a story's title; shorter ones are list items or subheadings.
TITLE_WORDS, STORY_WORDS = 4, 5
LIST_ITEM = re.compile(r"\s*»?\s*(?:[-–*•]|\d{1,3}[.)])\s+\S")
PARTS = re.compile(r"\s*[|·•/›>]\s*|\s*\*\s+")
CRUMB = re.compile(r"\s+[>›/»]\s+")
QUOTES = "\"'”»“)] "

BLANK, MESSAGE, LINK, RELATED_HEAD, CRUMB_LINE, MENU, TEXT, LIST, TABLE, TITLE = range(10)
NAMES = ("blank", "message", "link", "related_head", "crumb", "menu", "text", "list", "table", "title")
CONTENT = frozenset((TEXT, LIST, TABLE))
#: Flags of a line.
HINTED, MESSAGE_LIKE, LIST_LIKE, SHORT, STORY, HEADLINE = 1, 2, 4, 8, 16, 32


def clean(line: str) -> str:
    """One spelling per message: no decoration, single spaces, folded case."""
    if not line.isascii():
        line = line.replace("\u200b", "").replace("\xad", "")
    return " ".join(line.casefold().split()).lstrip(OPENING).rstrip(CLOSING)


def ends_sentence(cleaned: str) -> bool:
    return cleaned.rstrip(QUOTES).endswith((".", "!", "?", "…"))


def no_address(cleaned: str) -> str:
    if "/" in cleaned:
        cleaned = ADDRESS.sub("¶", cleaned)
    return MAIL.sub("¶", cleaned) if "@" in cleaned else cleaned


def masked(cleaned: str) -> str:
    """The form a line recurs by: placeholders become §, addresses, paths and names ¶, numbers and dates #; said once."""
    if "(" in cleaned:
        cleaned = REFERENCE.sub("", cleaned)
    if PLACEHOLDER_SIGN.search(cleaned):
        cleaned = PLACEHOLDER.sub("§", cleaned)
    cleaned = NUMBER.sub("#", no_address(cleaned))
    if "'" in cleaned or '"' in cleaned or "(" in cleaned or INNER_DOT.search(cleaned):
        cleaned = NAMED.sub("¶", cleaned)
    again = REPEATED.fullmatch(cleaned)
    return (again[1] if again else cleaned).strip(" .!")


def is_message(cleaned: str) -> bool:
    """Placeholder, filler or failure, and nothing else on the line but a reference in brackets or a label."""
    if "(" in cleaned:
        cleaned = REFERENCE.sub("", cleaned)
    rest = PLACEHOLDER.sub(" ", cleaned) if PLACEHOLDER_SIGN.search(cleaned) else cleaned
    if rest != cleaned:
        # a label such as 'by' or 'Price:' may stand beside the placeholder, a clause may not
        return len(WORD.findall(rest)) <= 2
    if FILLER.match(cleaned):
        return not FUNCTION_WORD.search(FILLER.sub(" ", cleaned)) and not any(c.isdigit() for c in cleaned)
    return bool(FAILURES.fullmatch(NUMBER.sub("#", no_address(cleaned)).strip(" .!")))


def menu_parts(cleaned: str) -> int:
    """How many menu words a line consists of, 0 if it holds anything else."""
    if not any(sign in cleaned for sign in "|·•/›>*"):
        return int(cleaned in MENU_WORDS)
    parts = [p for p in (p.strip(" *•·-") for p in PARTS.split(cleaned)) if p]
    return len(parts) if all(p in MENU_WORDS for p in parts) else 0


def list_like(c: str) -> bool:
    """Unbulleted list items: 'X: 12 things', 'X things, 12', 'see X at Y' and anything of few words."""
    head = c.partition(":")[0]
    return len(c.split()) < TITLE_WORDS or c.startswith("see ") or (head != c and len(head.split()) == 1)


def hints(cleaned: str) -> int:
    """Flags for the words of a line."""
    c = f" {cleaned} "
    menu_script = "script" in c and (" men" in c or "меню" in c)
    return HINTED * (menu_script or any(w in c for w in HINTS)) | MESSAGE_LIKE * any(w in c for w in MESSAGE_HINTS)


def kind(line: str) -> int:
    """The code of a line's form: a sentence is TEXT, a line of its own without full stop TITLE."""
    return look(line)[0]


def look(line: str) -> tuple[int, int, str]:
    """(code, flags, cleaned form) of a line."""
    c = clean(line)
    if not c:
        return BLANK, 0, c
    if is_message(c):
        return MESSAGE, 0, c  # before by-lines: 'by {{ name }}' is an unfilled one
    if META.fullmatch(c) or RELATED_INLINE.match(c):
        return LINK, 0, c
    if RELATED_HEADS.fullmatch(c):
        return RELATED_HEAD, 0, c
    n = menu_parts(c)
    if n:
        return (LINK if n > 1 else MENU), HINTED, c
    hint = hints(c)
    if len(c.split("|")) > 1 and not (len(c) > 160 and ends_sentence(c)):
        return TABLE, hint, c
    if LIST_ITEM.match(line):
        return LIST, hint, c
    first = CRUMB.search(c)
    if first and c[: first.start()] in MENU_WORDS:
        return CRUMB_LINE, 0, c
    words = len(c.split())
    if ends_sentence(c) or words >= LONG_TITLE:
        return TEXT, hint, c
    return TITLE, hint | LIST_LIKE * list_like(c) | SHORT * (words < 3) | STORY * (words >= STORY_WORDS), c


def line_hash(cleaned: str, flags: int) -> int:
    """62 bits of a line's masked form above two bits for the hints of its words."""
    h = xxhash.xxh3_64_intdigest(masked(cleaned)) & ~3 | flags & (HINTED | MESSAGE_LIKE)
    return h - 2**64 if h >= 2**63 else h


class Looks(dict):
    """(code, flags, characters, parts, hash, cleaned) of lines seen before; furniture repeats. Emptied at 100,000 lines."""

    def __missing__(self, line: str) -> tuple[int, int, int, int, int, str]:
        code, flags, c = look(line)
        h = line_hash(c, flags) if code in CONTENT or code in (TITLE, MENU) else 0
        v = code, flags, len(line.strip()), 1 + line.count("|") + line.count("·"), h, c if code in (TITLE, CRUMB_LINE) else ""
        if len(line) < 200:  # longer lines hardly ever come again
            if len(self) >= 100_000:
                self.clear()
            self[line] = v
        return v


LOOKS = Looks()
