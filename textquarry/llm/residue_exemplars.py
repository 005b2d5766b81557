"""Labelled exemplars of template residue, fixed texts.

Each list is one label. PART exemplars may lie anywhere in a value, WHOLE ones
must make up the value. CONTRAST pairs are words that, beside a placeholder,
show that a text is about placeholders. Spelling, case and accents are those of
the texts; MARK stands for an unfilled placeholder of any syntax.
"""

MARK = "placeholdermark"

# Names that template fields commonly have; in brackets that real text also
# uses ([x], <x>, :x:, {x}, (x)) only these, dotted and underscored names count.
FIELD_NAMES = (
    "summary description tagline title subtitle body content company product name author email date text message value subject "
    "slogan about heading headline keywords tags category city address phone username user customer client version language license "
    "descricao titulo motivo detalhe status total resumo nome autor mensagem texto empresa produto valor data"
).split()

INSTRUCTIONS_PART = [
    "insert a short description of the project",
    "insira aqui a descrição do projeto",
    "escriba aquí una descripción breve",
    "hier beschreibung einfügen",
    "décrivez votre projet ici",
    "descreva seu projeto aqui",
    "describa su proyecto aquí",
    "beschreiben sie hier ihr projekt",
    "insérez ici une description",
    "replace this text with your own summary",
    "replace this text with your own",
    "your project description goes here",
    "your text goes here",
    "describe your project in one line",
    "describe your project here",
    "sample project description edit me",
    "one sentence about what it does",
    "write a short description here",
    "add a description here",
    "add your description here",
    "todo describe this",
    "todo add description",
    "fixme write summary",
    "n a fill in later",
    "to be filled in later",
    "click here to edit this text",
]

INSTRUCTIONS_WHOLE = [
    "add description",
    "preencher depois",
    "enter text",
    "enter text here",
    "enter description",
    "title subtitle text",
    "tbd",
    "to be done",
    "to be determined",
    "todo",
    "fixme",
    "fill in later",
    "short description",
    "your description here",
    "description goes here",
    "no description",
    "no description provided",
    "change me",
    "edit me",
    "coming soon",
    "a definir",
    "por completar",
    "à compléter",
    "bitte ausfüllen",
]

ERRORS_PART = [
    "page not found go back to the start page",
    "página não encontrada volte para o início",
    "página no encontrada vuelva al inicio",
    "seite nicht gefunden",
    "erreur page introuvable",
    "servicio no disponible",
    "serviço indisponível no momento",
    "error interno del servidor",
    "erro interno do servidor",
    "acesso negado muitas solicitações vindas da sua rede",
    "acceso denegado demasiadas solicitudes",
    "access denied your request was blocked",
    "you do not have permission to access this page",
    "error 0 the page you asked for could not be shown",
    "the page you requested could not be found",
    "the requested url was not found on this server",
    "0 something went wrong on our side",
    "something went wrong please try again later",
    "http 0 upstream did not answer in time",
    "database connection failed code 0",
    "error establishing a database connection",
    "fatal error undefined index desc in view php on line 0",
    "traceback most recent call last keyerror summary",
    "null reference at line 0",
    "too many requests slow down",
    "the service is down for maintenance try again in a few minutes",
    "this site is down for maintenance",
    "we are sorry an unexpected error has occurred reference",
    "an unexpected error has occurred",
    "oops we lost that page",
    "whoops looks like this link is broken",
    "this project has been removed by its owner",
    "your session has ended sign in again to see this project",
    "your session has expired please log in again",
    "please wait while we redirect you",
    "you are being redirected please wait",
    "checking your browser this takes about 0 seconds",
    "verifying that you are human one moment",
    "please verify that you are human",
]

ERRORS_WHOLE = [
    "loading",
    "please wait",
    "just a moment",
    "page not found",
    "not found",
    "0 not found",
    "error 0",
    "http error 0",
    "forbidden",
    "0 forbidden",
    "access denied",
    "acesso negado",
    "página não encontrada",
    "página no encontrada",
    "page introuvable",
    "internal server error",
    "0 internal server error",
    "bad gateway",
    "0 bad gateway",
    "service unavailable",
    "0 service unavailable",
    "gateway timeout",
    "0 too many requests",
    "too many requests",
    "0 unauthorized",
    "undefined",
    "null",
    "nan",
    "object object",
    "carregando",
    "chargement",
    "cargando",
    "wird geladen",
]

SCRIPTS_PART = [
    "please turn on javascript to view this page",
    "please enable javascript to continue",
    "you need to enable scripts in your browser to run this app",
    "you need to enable javascript to run this app",
    "javascript is disabled in your browser",
    "this site requires javascript",
    "this page requires javascript",
    "noscript content hidden",
    "ative o javascript para continuar",
    "habilite o javascript no seu navegador",
    "seu navegador não permite scripts habilite e recarregue",
    "habilite javascript en su navegador",
    "active javascript pour afficher la page",
    "veuillez activer javascript",
    "bitte aktivieren sie javascript",
    "scripts are blocked allow them and reload",
    "cookies must be enabled to go on",
    "please enable cookies to continue",
    "os cookies devem estar ativados",
    "your browser is not supported please update it",
    "seu navegador não é suportado",
    "ihr browser wird nicht unterstützt",
]

# Bags: every word counts alone; lorem runs may lie anywhere, the others must
# make up the value.
LOREM_BAG = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat "
    "nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim laborum"
).split()
FILLER_BAG = (
    "asdf asdfasdf asdasd sdfsdf sdf fdsa qwer qwerty qwertz azerty zxcv zxcvbn hjkl jkl dfgh aaa aaaa xxx xxxx yyy zzz foo bar baz "
    "blah bla text texto test teste testing abc abcd 0"
).split()

CONTRAST_WORDS = (
    "expands expand expanding references reference fills fill filling marks mark markers syntax placeholder placeholders template templates templating "
    "substitutes substitute replaces interpolation interpolates variables variable"
).split()

#: The labelled table: label, scope and text. A "part" may lie anywhere, a
#: "whole" makes up the value, "run" and "bag" are lists of words, and "near" are
#: negative exemplars, two terms of which stand side by side.
EXEMPLARS = (
    [("instrucao", "part", t) for t in INSTRUCTIONS_PART]
    + [("erro", "part", t) for t in ERRORS_PART]
    + [("scripts", "part", t) for t in SCRIPTS_PART]
    + [("marcador", "part", MARK)]
    + [("instrucao", "whole", t) for t in INSTRUCTIONS_WHOLE]
    + [("erro", "whole", t) for t in ERRORS_WHOLE]
    + [("sobre", "near", f"{MARK} {w}") for w in CONTRAST_WORDS]
    + [("enchimento", "run", " ".join(LOREM_BAG)), ("enchimento", "bag", " ".join(FILLER_BAG))]
)
