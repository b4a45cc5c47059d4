"""Invented pages of many layouts whose main body is known, to fit the block labeller on.

A page is drawn from layouts (landmark elements, divs, table cells, bare body), ways of naming classes (telling names,
synonyms, generated letters, none), parts around the main body and four languages.  Main text is made of function words
and made-up words, so that the labeller learns layout and the small words, not subjects.
"""

from __future__ import annotations

import random

#: Function words by language.
_SMALL = {
    "en": "the a of to and in is that for it with as was on are by this from at or be have an they which you were not had has their more when who about can if out so what up into than them only some".split(),
    "de": "der die das und in zu den ist von mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie über einem so zum war haben nur oder aber vor".split(),
    "fr": "le la les de des et en un une du que est pour qui dans a par plus pas au sur ne se ce il sont avec on ses mais comme ou son nous cette aux leur été sa entre elle fait deux ces sans".split(),
    "es": "el la de que y en un una los se del las por con no su para es al lo como más pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta".split(),
}
_SOUNDS = {"en": ("br cl d f gr h l m n p r s st t th w", "a e i o ea ou", "n r st ck ll nd ng m t"), "de": ("b dr f g h kl l m n pf r s sch st w", "a e i o au ei ie ü", "n r st cht ng l ck nd"), "fr": ("b ch d f g j l m n p qu r s t v", "a e i o ai eau ou é", "n r t lle que ge s"), "es": ("b c d f g h l m n p r s t v", "a e i o ue ia", "n r s do ta ción l")}
#: Wording of the parts around a main body.
_AROUND = {
    "menu": {
        "en": "Home|About us|Products|Services|Blog|News|Contact|Help|Shop|Pricing|Login|Register|Careers|FAQ|Docs|Community|Support|Events|Gallery|Search".split("|"),
        "de": "Startseite|Über uns|Produkte|Leistungen|Blog|Aktuelles|Kontakt|Hilfe|Shop|Preise|Anmelden|Karriere|Fragen|Termine|Galerie|Suche".split("|"),
        "fr": "Accueil|À propos|Produits|Services|Blog|Actualités|Contact|Aide|Boutique|Tarifs|Connexion|Emploi|Questions|Agenda|Galerie|Recherche".split("|"),
        "es": "Inicio|Quiénes somos|Productos|Servicios|Blog|Noticias|Contacto|Ayuda|Tienda|Precios|Entrar|Empleo|Preguntas|Agenda|Galería|Buscar".split("|"),
    },
    "cookie": {
        "en": "We use cookies to improve your experience.|This site uses cookies. By continuing you agree to our policy.|Cookies help us deliver our services.|We and our partners store cookies on your device. You can change your choice at any time.".split("|"),
        "de": "Wir verwenden Cookies, um Ihnen das beste Erlebnis zu bieten.|Diese Seite nutzt Cookies. Mit der Nutzung stimmen Sie zu.|Cookies helfen uns, unsere Dienste zu erbringen.".split("|"),
        "fr": "Nous utilisons des cookies pour améliorer votre visite.|Ce site utilise des cookies. En continuant, vous les acceptez.|Les cookies nous aident à fournir nos services.".split("|"),
        "es": "Usamos cookies para mejorar su experiencia.|Este sitio utiliza cookies. Al continuar, acepta su uso.|Las cookies nos ayudan a prestar nuestros servicios.".split("|"),
    },
    "agree": {"en": "Accept|OK|Settings|Reject all".split("|"), "de": "Akzeptieren|OK|Einstellungen|Ablehnen".split("|"), "fr": "Accepter|OK|Paramètres|Refuser".split("|"), "es": "Aceptar|Vale|Ajustes|Rechazar".split("|")},
    "footer": {
        "en": "© {y} {n}. All rights reserved.|Copyright {y} {n} Ltd|All prices include tax.|Made with care in {n}.|{n} Ltd, 12 {n} Road, {n}|Registered in {n} under number {d}.|Powered by {n}".split("|"),
        "de": "© {y} {n}. Alle Rechte vorbehalten.|Copyright {y} {n} GmbH|Alle Preise inkl. MwSt.|{n} GmbH, {n}weg 4, {n}|Handelsregister {n} HRB {d}|Ein Angebot der {n}".split("|"),
        "fr": "© {y} {n}. Tous droits réservés.|Copyright {y} {n} SA|Prix toutes taxes comprises.|{n} SA, 3 rue {n}, {n}|RCS {n} {d}|Un site de {n}".split("|"),
        "es": "© {y} {n}. Todos los derechos reservados.|Copyright {y} {n} SL|Precios con impuestos incluidos.|{n} SL, calle {n} 8, {n}|Registro de {n}, hoja {d}|Un sitio de {n}".split("|"),
    },
    "legal": {"en": "Privacy|Terms|Imprint|Cookies|Accessibility|Sitemap|Contact".split("|"), "de": "Datenschutz|AGB|Impressum|Cookies|Barrierefreiheit|Sitemap|Kontakt".split("|"), "fr": "Confidentialité|Conditions|Mentions légales|Cookies|Accessibilité|Plan du site|Contact".split("|"), "es": "Privacidad|Condiciones|Aviso legal|Cookies|Accesibilidad|Mapa del sitio|Contacto".split("|")},
    "letter": {
        "en": "Subscribe to our newsletter|Sign up and never miss a post.|Get the latest news in your inbox every week.|Join {d} readers. No spam.".split("|"),
        "de": "Newsletter abonnieren|Melden Sie sich an und verpassen Sie nichts.|Jede Woche Neues per E-Mail. Kein Spam.".split("|"),
        "fr": "Abonnez-vous à notre lettre|Inscrivez-vous pour ne rien manquer.|Chaque semaine nos nouvelles par courriel.".split("|"),
        "es": "Suscríbase a nuestro boletín|Regístrese y no se pierda nada.|Cada semana nuestras noticias en su correo.".split("|"),
    },
    "author": {
        "en": "About the author|{n} {n} writes about {w} for this site.|{n} is an editor and lives in {n}. More posts by {n}.|By {n} {n}|Written by {n} {n}, {d} posts".split("|"),
        "de": "Über den Autor|{n} {n} schreibt hier über {w}.|{n} ist Redakteurin und lebt in {n}.|Von {n} {n}".split("|"),
        "fr": "À propos de l'auteur|{n} {n} écrit ici sur {w}.|{n} est rédactrice et vit à {n}.|Par {n} {n}".split("|"),
        "es": "Sobre el autor|{n} {n} escribe aquí sobre {w}.|{n} es redactora y vive en {n}.|Por {n} {n}".split("|"),
    },
    "related": {"en": "Related posts|You may also like|More from {n}|Read next|Latest articles|Popular|Recommended".split("|"), "de": "Ähnliche Beiträge|Das könnte Sie auch interessieren|Mehr aus {n}|Weiterlesen|Neueste Artikel|Beliebt".split("|"), "fr": "Articles liés|Vous aimerez aussi|Plus sur {n}|À lire ensuite|Derniers articles|Populaires".split("|"), "es": "Artículos relacionados|También le puede gustar|Más sobre {n}|Siga leyendo|Últimos artículos|Populares".split("|")},
    "more": {"en": "Read more|Continue reading|More »".split("|"), "de": "Mehr lesen|Weiter »".split("|"), "fr": "Lire la suite|Suite »".split("|"), "es": "Leer más|Seguir »".split("|")},
    "side": {"en": "Categories|Archive|Tags|About|Advertisement|Sponsored|Follow us|Opening hours".split("|"), "de": "Kategorien|Archiv|Schlagworte|Über uns|Anzeige|Folgen Sie uns|Öffnungszeiten".split("|"), "fr": "Catégories|Archives|Mots-clés|À propos|Publicité|Suivez-nous|Horaires".split("|"), "es": "Categorías|Archivo|Etiquetas|Sobre nosotros|Publicidad|Síganos|Horario".split("|")},
}
_SHARE = "Facebook|Twitter|X|LinkedIn|WhatsApp|E-Mail|Pinterest|Reddit|Telegram|Copy link".split("|")
#: Class names that sites give to parts.
_CLASSES = {
    "menu": "nav menu navbar main-nav topnav site-navigation navigation navlist header-links".split(), "head": "header site-header masthead top banner page-header".split(),
    "crumbs": "breadcrumb breadcrumbs crumbs trail path".split(), "cookie": "cookie cookie-banner consent gdpr notice cc-window".split(),
    "main": "content main article post entry-content body-text article-body post-content story markdown-body page-content text".split(), "wrap": "wrapper container page layout inner site grid row".split(),
    "side": "sidebar side widget-area aside secondary rail widgets col-right".split(), "share": "share social sharing share-buttons social-links".split(),
    "letter": "newsletter subscribe signup mailing-list optin".split(), "author": "author author-box byline bio about-author vcard".split(),
    "related": "related teaser teasers recommended more-posts cards read-next also-like".split(), "foot": "footer site-footer bottom colophon foot page-footer".split(),
}
_TAG = {"menu": "nav", "head": "header", "crumbs": "nav", "main": "main", "side": "aside", "foot": "footer", "author": "aside", "related": "section", "letter": "form", "share": "div", "cookie": "div", "wrap": "div"}


class _Page:
    """A page in the making: html pieces, each text marked as main or not by a private sign in front."""

    def __init__(self, rng: random.Random):
        self.r = rng
        self.lang = rng.choice(list(_SMALL))
        self.naming = rng.choice(["telling", "telling", "synonym", "generated", "none", "none"])
        self.landmarks = rng.random() < 0.45
        self.out: list[str] = []
        self.upper = rng.random() < 0.05
        self.generated = {k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 7))) for k in _CLASSES}

    def word(self) -> str:
        a, b, c = (x.split() for x in _SOUNDS[self.lang])
        return "".join(self.r.choice(a) + self.r.choice(b) for _ in range(self.r.randint(1, 2))) + self.r.choice(c)

    def name(self) -> str:
        return self.word().capitalize()

    def sentence(self, least: int = 5, most: int = 18) -> str:
        words = [self.r.choice(_SMALL[self.lang]) if self.r.random() < 0.5 else self.word() for _ in range(self.r.randint(least, most))]
        if self.r.random() < 0.15:
            words[self.r.randrange(len(words))] = str(self.r.randint(2, 2030))
        if self.r.random() < 0.3:
            words[self.r.randrange(len(words))] += ","
        return " ".join(words).capitalize() + self.r.choice("......?!:")

    def title(self) -> str:
        return " ".join(self.word() if self.r.random() < 0.7 else self.r.choice(_SMALL[self.lang]) for _ in range(self.r.randint(2, 8))).capitalize()

    def wording(self, part: str) -> str:
        text = self.r.choice(_AROUND[part][self.lang])
        while "{n}" in text:
            text = text.replace("{n}", self.name(), 1)
        return text.replace("{y}", str(self.r.randint(2005, 2026))).replace("{d}", str(self.r.randint(10, 99999))).replace("{w}", self.word())

    def open(self, part: str, tag: str | None = None) -> str:
        tag = tag or (_TAG[part] if self.landmarks else "div")
        given = {"telling": _CLASSES[part][0], "synonym": self.r.choice(_CLASSES[part]), "generated": self.generated[part], "none": ""}[self.naming]
        attribute = self.r.choice(["class", "class", "class", "id"])
        self.out.append(f"<{tag} {attribute}=\"{given}\">" if given and self.r.random() < 0.9 else f"<{tag}>")
        return tag

    def close(self, tag: str) -> None:
        self.out.append(f"</{tag}>")

    def put(self, tag: str, text: str, main: bool, link: bool = False) -> None:
        mark = "\ue001" if main else "\ue000"
        inner = f'<a href="/{self.word()}">{mark}{text}</a>' if link else mark + text
        self.out.append(f"<{tag}>{inner}" + ("" if tag in ("p", "li") and self.r.random() < 0.04 else f"</{tag}>"))

    def links(self, words: list[str], tag: str, main: bool = False) -> None:
        kind = self.r.choice(["ul", "ul", "ul", "div", "p"]) if tag == "li" else tag
        if kind == "ul":
            self.out.append("<ul>")
            for w in words:
                self.put("li", w, main, link=self.r.random() < 0.95)
            self.out.append("</ul>")
        elif kind == "div":
            self.out += [f'<a href="/{self.word()}">{w}</a> ' for w in words]
        else:
            self.out.append("<p>" + self.r.choice([" | ", " · ", " "]).join(f'<a href="/x">{w}</a>' for w in words) + "</p>")

    def menu(self) -> None:
        tag = self.open("menu")
        self.links(self.r.sample(_AROUND["menu"][self.lang], self.r.randint(3, 9)), "li")
        self.close(tag)

    def head(self) -> None:
        tag = self.open("head")
        if self.r.random() < 0.7:
            self.put(self.r.choice(["p", "div", "h2"]), self.name(), False, link=self.r.random() < 0.7)
        if self.r.random() < 0.3:
            self.put("p", self.sentence(3, 7), False)
        self.menu()
        self.close(tag)

    def crumbs(self) -> None:
        tag = self.open("crumbs")
        steps = [self.r.choice(_AROUND["menu"][self.lang]), self.name(), self.title()][: self.r.randint(2, 3)]
        if self.r.random() < 0.5:
            self.links(steps, "li")
        else:
            sign = self.r.choice([" › ", " / ", " > ", " » "])
            self.out.append("<p>" + sign.join(f'<a href="/{i}">{s}</a>' for i, s in enumerate(steps)) + "</p>")
        self.close(tag)

    def cookie(self) -> None:
        tag = self.open("cookie")
        self.put(self.r.choice(["p", "p", "div"]), self.wording("cookie"), False)
        for _ in range(self.r.randint(1, 2)):
            self.put(self.r.choice(["button", "a"]), self.wording("agree"), False)
        self.close(tag)

    def side(self) -> None:
        tag = self.open("side")
        for _ in range(self.r.randint(1, 4)):
            self.put(self.r.choice(["h3", "h2", "h4", "p"]), self.wording("side"), False)
            way = self.r.random()
            if way < 0.6:
                self.links([self.title() for _ in range(self.r.randint(2, 8))], "li")
            elif way < 0.8:
                self.put("p", self.sentence() + (" " + self.sentence() if self.r.random() < 0.5 else ""), False)
            else:
                self.links([self.word() for _ in range(self.r.randint(3, 9))], "p")
        self.close(tag)

    def share(self) -> None:
        tag = self.open("share")
        self.links(self.r.sample(_SHARE, self.r.randint(2, 5)), "li")
        self.close(tag)

    def letter(self) -> None:
        tag = self.open("letter")
        for _ in range(self.r.randint(1, 2)):
            self.put(self.r.choice(["p", "p", "h3", "div"]), self.wording("letter"), False)
        self.out.append('<input name="email"><button>OK</button>')
        self.close(tag)

    def author(self) -> None:
        tag = self.open("author")
        if self.r.random() < 0.3:
            self.out.append('<img src="/a.jpg">')
        for _ in range(self.r.randint(1, 3)):
            self.put(self.r.choice(["p", "p", "h4", "div"]), self.wording("author"), False)
        self.close(tag)

    def related(self) -> None:
        tag = self.open("related")
        self.put(self.r.choice(["h2", "h3", "h4", "p"]), self.wording("related"), False)
        if self.r.random() < 0.5:
            self.links([self.title() for _ in range(self.r.randint(2, 7))], "li")
        else:
            for _ in range(self.r.randint(2, 4)):
                card = self.r.choice(["div", "div", "article", "section", ""])
                if card:
                    self.out.append(f"<{card}>")
                self.put("h3", self.title(), False, link=True)
                self.put("p", self.sentence(), False)
                if self.r.random() < 0.5:
                    self.put("p", self.wording("more"), False, link=True)
                if card:
                    self.out.append(f"</{card}>")
        self.close(tag)

    def foot(self) -> None:
        tag = self.open("foot")
        parts = [self._legal, *[self._small] * self.r.randint(1, 3)]
        if self.r.random() < 0.3:
            parts.append(self.letter)
        if self.r.random() < 0.25:
            parts.append(self.share)
        self.r.shuffle(parts)
        for p in parts:
            p()
        self.close(tag)

    def _legal(self) -> None:
        self.links(self.r.sample(_AROUND["legal"][self.lang], self.r.randint(2, 5)), "li")

    def _small(self) -> None:
        self.put(self.r.choice(["p", "p", "div", "span"]), self.wording("footer"), False)

    def passage(self, tag: str) -> None:
        """A paragraph or item of the main body, some with links or emphasis inside."""
        text = " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 2, 3, 4, 6])))
        if tag == "li":
            text = self.title() if self.r.random() < 0.4 else self.sentence(3, 12)
        way = self.r.random()
        if way < 0.25 and " " in text:
            words = text.split(" ")
            k = self.r.randrange(len(words))
            inside = self.r.choice(["a href='/x'", "b", "em", "strong", "code"])
            words[k] = f"<{inside}>{words[k]}</{inside.split()[0]}>"
            text = " ".join(words)
        self.put(tag, text, True)

    def body(self) -> None:
        if self.r.random() < 0.92:
            self.put(self.r.choice(["h1"] * 9 + ["h2"]), self.title(), True)
        if self.r.random() < 0.25:
            self.put(self.r.choice(["div", "span"]), f"{self.r.randint(1, 28)}.{self.r.randint(1, 12)}.2024", False)
        if self.r.random() < 0.2:
            self.author()
        if self.r.random() < 0.15:
            self.share()
        for k in range(self.r.choice([1, 2, 3, 4, 5, 6, 8, 11, 16])):
            way = self.r.random()
            if k and way < 0.22:
                self.put(self.r.choice(["h2", "h2", "h3"]), self.title(), True)
            elif way < 0.28:
                self.out.append(self.r.choice(['<img src="/p.jpg" alt="x">', '<figure><img src="/p.jpg"></figure>', "<hr>"]))
            elif way < 0.33:
                self.out.append("<blockquote>")
                self.passage("p")
                self.out.append("</blockquote>")
            elif way < 0.48:
                kind = self.r.choice(["ul", "ul", "ol"])
                self.out.append(f"<{kind}>")
                for _ in range(self.r.randint(2, 7)):
                    self.passage("li")
                self.out.append(f"</{kind}>")
            elif way < 0.52:
                self.out.append("<table>" + "".join(f"<tr><td>{self.word()}</td><td>{self.r.randint(1, 99)}</td></tr>" for _ in range(3)) + "</table>")
            elif way < 0.58:
                self.out.append("<div>")
                self.passage("p")
                self.out.append("</div>")
            elif way < 0.61 and k:
                self.r.choice([self.letter, self.related, self.share])()
            self.passage("p")
        for part, share in ((self.share, 0.3), (self.author, 0.3), (self.letter, 0.2), (self.related, 0.3)):
            if self.r.random() < share:
                part()

    def make(self) -> str:
        r = self.r
        if r.random() < 0.25:
            self.cookie()
        wraps = [self.open("wrap", "div") for _ in range(r.choice([0, 0, 1, 1, 2, 3]))]
        if r.random() < 0.9:
            r.choice([self.head, self.head, self.menu])()
        if r.random() < 0.35:
            self.crumbs()
        frame = r.random()
        if frame < 0.12:  # a table of columns
            self.out.append("<table><tr>")
            cells = [self.side, None] if r.random() < 0.6 else [None, self.side]
            for cell in cells:
                self.out.append("<td>")
                cell() if cell else self.body()
                self.out.append("</td>")
            self.out.append("</tr></table>")
        else:
            first = r.random() < 0.15
            if first:
                self.side()
            tag = None if frame < 0.25 else self.open("main", r.choice([None, None, "article", "div", "section"]))
            inner = self.open("main", r.choice(["div", "article", "section"])) if tag and r.random() < 0.3 else None
            self.body()
            if inner:
                self.close(inner)
            if tag:
                self.close(tag)
            if not first and r.random() < 0.35:
                self.side()
            if r.random() < 0.2:
                self.related()
        for w in wraps[1:]:
            self.close(w)
        if r.random() < 0.93:
            self.foot()
        if wraps:
            self.close(wraps[0])
        if r.random() < 0.15:
            self.cookie()
        text = "".join(x + (r.choice(["\n", "", " "])) for x in self.out)
        return f"<!doctype html><html><head><title>{self.title()}</title></head><body>{text}</body></html>"


def page(seed: int) -> str:
    """The html of one invented page; each text is preceded by U+E001 if it is of the main body, else by U+E000."""
    return _Page(random.Random(seed)).make()
