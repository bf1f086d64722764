"""Roles, uses, categories and the phrases and markers that point to them."""

from __future__ import annotations

BODY, NOTE, BIBLIOGRAPHY, ANALYTIC_INDEX, CONTENTS = "body", "note", "bibliography", "analytic_index", "contents"
PARATEXT, THRESHOLD, APPENDIX, UNCERTAIN = "paratext", "threshold", "appendix", "uncertain"
ROLES = (BODY, NOTE, BIBLIOGRAPHY, ANALYTIC_INDEX, CONTENTS, PARATEXT, THRESHOLD, APPENDIX, UNCERTAIN)
TEXTUAL = (BODY, THRESHOLD, APPENDIX)
#: Roles whose documents are neither text nor notes.
APPARATUS = (BIBLIOGRAPHY, ANALYTIC_INDEX, CONTENTS, PARATEXT)

MAIN, ON_REQUEST, EXCLUDED = "main", "on_request", "excluded"
CATEGORIES = ("work_text", "note", "bibliography", "index", "paratext")

ROLE_CATEGORY = {
    BODY: "work_text", THRESHOLD: "work_text", APPENDIX: "work_text", UNCERTAIN: "work_text", NOTE: "note",
    BIBLIOGRAPHY: "bibliography", ANALYTIC_INDEX: "index", CONTENTS: "index", PARATEXT: "paratext",
}
CATEGORY_USE = {"work_text": MAIN, "note": ON_REQUEST, "bibliography": EXCLUDED, "index": EXCLUDED, "paratext": EXCLUDED}
#: Which of equally often declared roles a block takes: the more specific.
SPECIFICITY = (NOTE, BIBLIOGRAPHY, ANALYTIC_INDEX, CONTENTS, PARATEXT, THRESHOLD, APPENDIX, BODY)

#: Synthetic marker of a container whose text runs [1] [2] [3] with as many links.
NUMBERED_NOTES = "__numbered_linked_notes__"

# The words, markers, patterns and formats below are part of the results' definition.

SEARCHABLE_PARATEXT = (
    "dedica", "ringraziamenti", "epigrafe", "avvertenza dell'editore", "dedication", "acknowledgements",
    "acknowledgments", "epigraph", "widmung", "danksagung", "dedicace", "remerciements", "epigraphe", "dedicatoria",
    "agradecimientos",
)
SEARCHABLE_EPUB_TYPES = ("dedication", "acknowledgments", "epigraph")
SEARCHABLE_ARIA = ("doc-dedication", "doc-acknowledgments", "doc-epigraph")

IMAGE_CREDIT_HEADINGS = (
    "referenze fotografiche", "crediti fotografici", "referenze iconografiche", "crediti iconografici",
    "fonti fotografiche", "fonti iconografiche", "crediti delle immagini", "photo credits", "photographic credits",
    "image credits", "picture credits", "illustration credits", "bildnachweis", "bildnachweise", "fotonachweis",
    "fotonachweise", "credits photographiques", "credits iconographiques", "creditos fotograficos",
    "creditos de imagenes",
)
EDITORIAL_HEADINGS = (
    "copertina", "frontespizio", "copyright", "colophon", "crediti", "il libro", "trama", "sinossi", "l'autore",
    "l'autrice", "gli autori", "autori", "biografia", "notizie sull'autore", "notizie sull'autrice",
    "nota sull'autore", "nota sull'autrice", "biografia dell'autore", "biografia dell'autrice", "dello stesso autore",
    "della stessa autrice", "cover", "title page", "copyright and info", "about the book", "synopsis",
    "book description", "plot summary", "about the author", "about the authors", "authors", "biography",
    "author biography", "author bio", "also by", "umschlag", "titelei", "impressum", "uber den autor", "autoren",
    "biografie", "uber die autorin", "autorenbiografie", "kurzbeschreibung", "buchbeschreibung", "couverture",
    "page de titre", "a propos du livre", "resume du livre", "a propos de l'auteur", "a propos de l'autrice",
    "auteurs", "biographie", "biographie de l'auteur", "biographie de l'autrice", "de meme auteur", "cubierta",
    "portada", "creditos", "sobre el libro", "sinopsis", "resumen del libro", "sobre el autor", "sobre la autora",
    "autores", "biografia del autor", "biografia de la autora",
    *IMAGE_CREDIT_HEADINGS,
)
DIDACTIC_HEADINGS = ("domande", "esercizi", "quesiti", "domande di discussione", "questions", "exercises", "discussion questions")
AUTHOR_HEADINGS = (
    "biografia", "notizie sull'autore", "notizie sull'autrice", "nota sull'autore", "nota sull'autrice",
    "biografia dell'autore", "biografia dell'autrice", "about the author", "about the authors", "author biography",
    "author bio", "biography", "uber den autor", "uber die autorin", "autorenbiografie", "a propos de l'auteur",
    "a propos de l'autrice", "biographie de l'auteur", "biographie de l'autrice", "sobre el autor",
    "sobre la autora", "biografia del autor", "biografia de la autora",
)
DEDICATION_PREPOSITIONS = ("a", "ad", "al", "allo", "alla", "ai", "agli", "alle", "to", "for", "fur", "au", "aux", "pour", "para")
PROMOTION = (
    "ti e piaciuto questo libro", "scoprire nuovi autori", "iscriverti alla nostra newsletter", "seguici su",
    "booktrailer", "leggi qui la scheda", "leggete qui la scheda", "visita il nostro sito", "scarica il catalogo",
    "registrati e ricevi", "did you enjoy this book", "discover new authors", "sign up for our newsletter",
    "subscribe to our newsletter", "follow us", "like us on", "watch us on", "join us on", "shop online",
    "hat ihnen dieses buch gefallen", "neue autoren entdecken", "newsletter abonnieren", "folgen sie uns",
    "vous avez aime ce livre", "decouvrir de nouveaux auteurs", "inscrivez vous a notre newsletter", "suivez nous",
    "te ha gustado este libro", "descubrir nuevos autores", "suscribete a nuestro boletin", "siguenos",
)
STRONG_PROMOTION = ("leggi qui la scheda", "leggete qui la scheda", "visita il nostro sito", "scarica il catalogo", "registrati e ricevi")
EDITORIAL_CREDITS = (
    "acquisitions editor", "compilation editor", "copy editor", "production editor", "technical editor",
    "project manager", "art coordinator", "cover photos", "cover photo", "cover design", "editor responsabile",
    "redattore", "revisione editoriale", "progetto grafico", "grafica di copertina", "foto di copertina",
    "verantwortlicher redakteur", "umschlaggestaltung", "directeur editorial", "revision editoriale",
    "conception graphique", "editor responsable", "revision editorial", "diseno de cubierta",
)
USER_LICENCES = (
    "end user license agreement", "ebook license agreement", "ebook eula", "contratto di licenza per l'utente finale",
    "licenza utente finale", "endbenutzer lizenzvereinbarung", "endbenutzer lizenzvertrag",
    "contrat de licence utilisateur final", "accord de licence utilisateur final",
    "acuerdo de licencia de usuario final", "contrato de licencia de usuario final",
)
COLLECTION_REFERENCES = (
    "fa parte della raccolta", "fanno parte della raccolta", "fa parte della piu ampia raccolta",
    "fanno parte della piu ampia raccolta",
)
BACKLIST = (
    "ultimi volumi pubblicati", "altri volumi pubblicati", "titoli pubblicati", "novita in collana",
    "collana diretta da", "recent titles", "other titles published", "also available", "zuletzt erschienen",
    "weitere titel", "derniers titres parus", "autres titres publies", "ultimos titulos publicados",
    "otros titulos publicados",
)
CATALOGUE_PUBLISHERS = (
    ("catalogo", ("editore", "edizioni", "casa editrice", "editorial")),
    ("catalog", ("publisher", "publishing")),
    ("catalogue", ("publisher", "editeur")),
    ("katalog", ("verlag",)),
)
RIGHTS = ("copyright", "tutti i diritti riservati", "all rights reserved")
PUBLISHER_MARKS = (
    "isbn", "edizioni", "editore", "casa editrice", "prima edizione", "publisher", "published by", "first published",
    "verlag", "editeur", "editorial",
)
PRINTING_MARKS = (
    "finito di stampare", "stampato presso", "printed in italy", "stabilimento di", "registr trib",
    "registrazione tribunale", "direttore responsabile",
)
CONTENTS_OPENINGS = (
    "indice", "sommario", "indice generale", "contents", "table of contents", "inhalt", "inhaltsverzeichnis",
    "sommaire", "table des matieres", "contenido", "sumario",
)
FURTHER_READING = ("ulteriori letture", "further reading", "weiterfuhrende literatur", "lectures complementaires", "lecturas adicionales")
BOOK_INTRODUCTIONS = ("in questo libro", "this book", "in diesem buch", "dans ce livre", "en este libro")
#: Phrases that count only where they are the whole title.
WHOLE_TITLE_ONLY = ("nota", "fonti", "sources", "quellen", "fuentes")
SPACED_NOTE_HEADINGS = ("n ota", "n ote", "n otes")
NOTES_AND_REFERENCES = "note e riferimenti bibliografici"
CHAPTER_PLAN = "piano del capitolo"

TITLE_PHRASES = {
    "it": {
        NOTE: ("note", "nota", "nota al testo", "note al testo", "note bibliografiche", "nota del traduttore", "note del traduttore", "annotazioni"),
        BIBLIOGRAPHY: (
            "bibliografia", "nota bibliografica", "selezione bibliografica", "fonti bibliografiche", "riferimenti bibliografici", "fonti",
            "opere citate", "bibliografia essenziale", "letture"
        ),
        CONTENTS: (
            "indice", "sommario", "indice generale", "elenco delle illustrazioni", "indice delle illustrazioni", "elenco delle figure",
            "indice delle figure"
        ),
        PARATEXT: (
            "copertina", "frontespizio", "occhiello", "colophon", "copyright", "dedica", "ringraziamenti", "l'autore",
            "l'autrice", "gli autori", "dello stesso autore", "della stessa autrice", "il libro", "nota dell'editore",
            "avvertenza", "crediti", "quest'opera", "notizie sull'autore", "notizie sull'autrice", "nota sull'autore",
            "nota sull'autrice", "biografia dell'autore", "biografia dell'autrice",
        ),
        THRESHOLD: (
            "prefazione", "introduzione", "premessa", "postfazione", "prologo", "epilogo", "conclusioni", "conclusione", "nota introduttiva",
            "note conclusive", "presentazione", "avvertenza dell'autore", "nota editoriale"
        ),
        APPENDIX: ("appendice", "appendici", "allegati", "documenti", "cronologia", "glossario", "tavole"),
        ANALYTIC_INDEX: (
            "indice analitico", "indice dei nomi", "indice dei luoghi", "indice delle cose notevoli", "indice dei temi", "abbreviazioni",
            "elenco delle abbreviazioni", "sigle"
        ),
        BODY: ("capitolo", "parte", "libro primo", "libro secondo", "sezione"),
    },
    "en": {
        NOTE: ("notes", "endnotes", "footnotes", "notes to the text"),
        BIBLIOGRAPHY: ("bibliography", "references", "works cited", "further reading", "sources"),
        ANALYTIC_INDEX: ("index", "name index", "subject index", "general index", "abbreviations", "list of abbreviations"),
        CONTENTS: ("contents", "table of contents", "list of illustrations", "list of figures"),
        PARATEXT: (
            "cover", "title page", "half title", "copyright", "colophon", "dedication", "acknowledgements", "acknowledgments", "about the author",
            "also by", "about the authors", "author biography", "author bio", "front matter", "back matter"
        ),
        THRESHOLD: ("preface", "introduction", "foreword", "prologue", "epilogue", "afterword", "conclusion"),
        APPENDIX: ("appendix", "appendices", "glossary", "chronology", "tables"),
        BODY: ("chapter", "part", "book one", "book two", "section"),
    },
    "de": {
        NOTE: ("anmerkungen", "fussnoten", "fußnoten", "endnoten"),
        BIBLIOGRAPHY: ("literaturverzeichnis", "bibliographie", "quellen", "literatur"),
        ANALYTIC_INDEX: ("register", "namenregister", "sachregister", "abkurzungen", "abkurzungsverzeichnis"),
        CONTENTS: ("inhalt", "inhaltsverzeichnis", "abbildungsverzeichnis", "verzeichnis der abbildungen"),
        PARATEXT: ("impressum", "widmung", "danksagung", "uber den autor", "uber die autorin", "autorenbiografie", "umschlag", "titelei"),
        THRESHOLD: ("vorwort", "einleitung", "nachwort", "prolog", "epilog"),
        APPENDIX: ("anhang", "glossar", "zeittafel"),
        BODY: ("kapitel", "teil", "abschnitt"),
    },
    "fr": {
        NOTE: ("notes", "notes du traducteur"),
        BIBLIOGRAPHY: ("bibliographie", "references", "sources", "ouvrages cites"),
        ANALYTIC_INDEX: ("index", "index des noms", "abreviations", "liste des abreviations"),
        CONTENTS: ("sommaire", "table des matieres", "liste des illustrations", "table des illustrations"),
        PARATEXT: (
            "couverture", "page de titre", "copyright", "dedicace", "remerciements", "a propos de l'auteur", "a propos de l'autrice",
            "biographie de l'auteur", "biographie de l'autrice", "de meme auteur"
        ),
        THRESHOLD: ("preface", "introduction", "avant-propos", "postface", "prologue", "epilogue", "conclusion"),
        APPENDIX: ("annexe", "annexes", "glossaire", "chronologie"),
        BODY: ("chapitre", "partie", "livre premier"),
    },
    "es": {
        NOTE: ("notas", "notas al texto"),
        BIBLIOGRAPHY: ("bibliografia", "referencias", "obras citadas", "fuentes"),
        ANALYTIC_INDEX: ("indice analitico", "indice de nombres", "abreviaturas", "lista de abreviaturas"),
        CONTENTS: ("indice", "contenido", "sumario", "lista de ilustraciones", "indice de ilustraciones"),
        PARATEXT: (
            "cubierta", "portada", "creditos", "dedicatoria", "agradecimientos", "sobre el autor", "sobre la autora", "biografia del autor",
            "biografia de la autora"
        ),
        THRESHOLD: ("prefacio", "introduccion", "prologo", "epilogo", "conclusion"),
        APPENDIX: ("apendice", "anexo", "glosario", "cronologia"),
        BODY: ("capitulo", "parte", "seccion"),
    },
}

EPUB_TYPE_ROLE = {
    "footnote": NOTE, "footnotes": NOTE, "endnote": NOTE, "endnotes": NOTE, "rearnote": NOTE, "rearnotes": NOTE,
    "noteref": NOTE, "bibliography": BIBLIOGRAPHY, "biblioentry": BIBLIOGRAPHY, "index": ANALYTIC_INDEX,
    "toc": CONTENTS, "landmarks": CONTENTS, "cover": PARATEXT, "titlepage": PARATEXT, "halftitlepage": PARATEXT,
    "copyright-page": PARATEXT, "colophon": PARATEXT, "dedication": PARATEXT, "epigraph": PARATEXT,
    "abstract": PARATEXT, "acknowledgments": PARATEXT, "imprimatur": PARATEXT, "preface": THRESHOLD,
    "foreword": THRESHOLD, "introduction": THRESHOLD, "prologue": THRESHOLD, "epilogue": THRESHOLD,
    "afterword": THRESHOLD, "conclusion": THRESHOLD, "appendix": APPENDIX, "glossary": APPENDIX,
    "chronology": APPENDIX, "chapter": BODY, "part": BODY, "division": BODY, "bodymatter": BODY, "volume": BODY,
    "subchapter": BODY,
}
ARIA_ROLE = {
    "doc-footnote": NOTE, "doc-endnote": NOTE, "doc-endnotes": NOTE, "doc-noteref": NOTE,
    "doc-bibliography": BIBLIOGRAPHY, "doc-biblioentry": BIBLIOGRAPHY, "doc-index": ANALYTIC_INDEX,
    "doc-toc": CONTENTS, "doc-cover": PARATEXT, "doc-colophon": PARATEXT, "doc-credits": PARATEXT,
    "doc-dedication": PARATEXT, "doc-epigraph": PARATEXT, "doc-abstract": PARATEXT, "doc-acknowledgments": PARATEXT,
    "doc-preface": THRESHOLD, "doc-foreword": THRESHOLD, "doc-prologue": THRESHOLD, "doc-epilogue": THRESHOLD,
    "doc-afterword": THRESHOLD, "doc-conclusion": THRESHOLD, "doc-appendix": APPENDIX, "doc-glossary": APPENDIX,
    "doc-chapter": BODY, "doc-part": BODY,
}
MARKER_ROLE = {
    "footnote": NOTE, "footnotes": NOTE, "endnote": NOTE, "endnotes": NOTE, "rearnote": NOTE, "rearnotes": NOTE,
    "xfootnote": NOTE, "x-footnote": NOTE, "x_footnote": NOTE, "testo_nota": NOTE, "testo-nota": NOTE,
    "note_pie_di_pagina": NOTE, "note_pie_di_pagina_sotto": NOTE, "noteh": NOTE, NUMBERED_NOTES: NOTE,
    "bibliography": BIBLIOGRAPHY, "references": BIBLIOGRAPHY, "subject-index": ANALYTIC_INDEX,
    "name-index": ANALYTIC_INDEX, "table-of-contents": CONTENTS, "toc": CONTENTS, "cover": PARATEXT,
    "titlepage": PARATEXT, "title-page": PARATEXT, "halftitlepage": PARATEXT, "halftitle": PARATEXT,
    "half-title": PARATEXT, "bastard-title": PARATEXT, "occhiello": PARATEXT, "occhiello_n": PARATEXT,
    "occhiello-n": PARATEXT, "faux-titre": PARATEXT, "schmutztitel": PARATEXT, "anteportada": PARATEXT,
    "copyright-page": PARATEXT, "colophon": PARATEXT, "dedication": PARATEXT, "preface": THRESHOLD,
    "foreword": THRESHOLD, "introduction": THRESHOLD, "prologue": THRESHOLD, "epilogue": THRESHOLD,
    "afterword": THRESHOLD, "appendix": APPENDIX, "glossary": APPENDIX, "chronology": APPENDIX,
}
#: Families of markers, as whole-token patterns, for tokens that MARKER_ROLE does not list.
MARKER_FAMILIES = (
    (r"titlepage\d+", PARATEXT),
    (r"fnote\d*", NOTE),
    (r"fn(?:\d*|[_-](?:t|text))", NOTE),
    (r"footnote[-_]\d+", NOTE),
    (r"bib\d*", BIBLIOGRAPHY),
    (r"biblio(?:[-_][a-z0-9]+)*", BIBLIOGRAPHY),
    (r"dedica\d*", PARATEXT),
    (r"(?:[a-z0-9]+[-_])*frontespizio(?:\d*|(?:[-_][a-z0-9]+)*)", PARATEXT),
)

_W = r"[\p{L}\p{N}_]"
_FROM, _TO, _ON = rf"(?<!{_W})", rf"(?!{_W})", rf"(?={_W})"

NOTE_NAME = r"(?:^|[_\-.])(?:ftn\d*|footnotes?|endnotes?|notes?)(?:[_\-.]|$)"
INDEX_NAME = r"(?:^|[_\-.])(?:index|indices?|indice|indici|toc)(?:[_\-.]|$)"
BIBLIOGRAPHY_NAME = r"(?:^|[_\-.])(?:bibliograph(?:y|ie|ia)|references?)(?:[_\-.]|$)"
FRONT_PAGE_NAME = r"(?:[fp]\d+[_-])?(?:title(?:page)?|frontispiece|frontespizio)(?:[_-]?\d*)?\.(?:xhtml|html|htm)"
PROMOTION_NAME = r"(?:^|[_\-.])(?:promo\d*|promotional|catalog(?:o|ue)?|backlist)(?:[_\-.]|$)"
SPLIT_INDEX_NAME = r"^index[_\-.]+split[_\-.]*\d+\.(?:x?html?|htm)$"
YEAR = rf"{_FROM}(?:1[5-9]\p{{Nd}}{{2}}|20[0-4]\p{{Nd}}){_TO}"
CITATION = rf"(?iu){_FROM}(?:(?:cfr|ibid|ibidem|op\. cit|art\. cit|vol|pp|trad|a cura di){_TO}|(?:p\.|ed\.){_ON})"
CITATION_FEATURE = rf"(?iu){_FROM}(?:(?:cfr|ibid|ibidem|op\. cit|art\. cit|vol|pp|trad|a cura di|works cited|references){_TO}|(?:p\.|ed\.){_ON})"
NUMBER = rf"{_FROM}\p{{Nd}}+{_TO}"
CAPTION = rf"(?iu)(?:^|[\s\p{{Z}}])(?:f\s*ig(?:ura)?|figure|abbildung|tavola)\.?\s*\p{{Nd}}|{_FROM}(?:tavola|foto|photo|photograph|fotografia){_TO}"
SHORT_EDITORIAL = rf"(?iu){_FROM}(?:isbn|copyright|editore|edizioni|publisher|verlag){_TO}|www\.|https?://|©|all rights reserved"
URL = r"(?i)(?:https?://|www\.)"
IMAGE_WORDS = r"^(?:immagine|image|illustrazione|illustration|foto|photo|fotografia)(?![0-9a-z_])"
THEMATIC_NOTE = r"^(?:note? (?:su|sul|sulla|sui|sugli|sulle)|notes? (?:on|about)|notes? sur) \S"
NUMBERED_HEADING = r"^\d+(?:\.\d+)+\s+\S|^(?:capitolo|chapter|azione)\s+\d+(?![0-9\p{L}_])"
