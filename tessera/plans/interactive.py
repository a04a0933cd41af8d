"""A session on the console: plain text searches, lines that begin with a slash change settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from tessera.plans.catalog import Catalog, Filters, format_price, page

HELP = """/toate | /top N | /sharduri N sau toate | /pagina N
/categorie X | /brand X | /culoare X | /audienta X | /pret-min N | /pret-max N | /stoc da sau nu
/fara-filtre | /filtre | /ajutor | /iesire
Valoarea '-' elimină un filtru."""

#: Names of each command; the first is the documented one.
COMMANDS = {
    "quit": ("iesire", "exit", "quit", "q"),
    "help": ("ajutor", "help", "h", "?"),
    "all": ("toate", "all"),
    "top": ("top",),
    "shards": ("sharduri", "shards"),
    "page": ("pagina", "page"),
    "category": ("categorie", "category"),
    "brand": ("brand",),
    "color": ("culoare", "color"),
    "audience": ("audienta", "audiență", "audience"),
    "price_min": ("pret-min", "preț-min", "price-min"),
    "price_max": ("pret-max", "preț-max", "price-max"),
    "stock": ("stoc", "stock"),
    "clear": ("fara-filtre", "fără-filtre", "clear-filters"),
    "status": ("filtre", "filters", "status"),
}
_MEANING = {name: command for command, names in COMMANDS.items() for name in names}


@dataclass
class Session:
    all_results: bool = True
    top_k: int = 10
    probe_shards: int | None = None
    page_size: int = 10
    filters: Filters = field(default_factory=Filters)

    def status(self) -> str:
        mode = "toate rezultatele" if self.all_results else f"primele {self.top_k} din {self.probe_shards or 'numărul implicit de'} sharduri"
        active = [f"{k}={v}" for k, v in vars(self.filters).items() if v not in (None, False)]
        return f"Mod: {mode}; {self.page_size} pe pagină; filtre: {', '.join(active) or 'niciunul'}"


def _whole(value: str, most: int | None = None) -> int | None:
    return int(value) if value.isdigit() and int(value) >= 1 and (most is None or int(value) <= most) else None


def command(line: str, session: Session, shards: int) -> tuple[bool, str]:
    """Carry out a slash command: (whether the session goes on, the answer)."""
    name, _, value = line[1:].strip().partition(" ")
    value, what = value.strip(), _MEANING.get(name.casefold())
    if what is None:
        return True, "Comandă necunoscută. Folosește /ajutor."
    if what == "quit":
        return False, "La revedere."
    if what == "help":
        return True, HELP
    if what == "all":
        session.all_results = True
    elif what in ("top", "page"):
        count = _whole(value)
        if count is None:
            return True, f"Folosește /{name} urmat de un număr pozitiv."
        if what == "top":
            session.top_k, session.all_results = count, False
        else:
            session.page_size = count
    elif what == "shards":
        if value.casefold() in ("toate", "all"):
            session.probe_shards = shards
        elif (count := _whole(value, shards)) is None:
            return True, f"Alege un număr între 1 și {shards} sau toate."
        else:
            session.probe_shards, session.all_results = count, False
    elif what in ("price_min", "price_max"):
        try:
            number = None if value in ("", "-") else float(value.replace(",", "."))
        except ValueError:
            return True, "Prețul trebuie să fie un număr sau '-'."
        session.filters = replace(session.filters, **{what: number})
    elif what == "stock":
        if value.casefold() not in ("da", "nu", "on", "off", "true", "false", "1", "0"):
            return True, "Folosește /stoc da sau /stoc nu."
        session.filters = replace(session.filters, in_stock_only=value.casefold() in ("da", "on", "true", "1"))
    elif what == "clear":
        session.filters = Filters()
    elif what != "status":
        session.filters = replace(session.filters, **{what: None if value in ("", "-") else value})
    return True, session.status()


def run(catalog: Catalog, session: Session | None = None, read: Callable[[str], str] = input, write: Callable[[str], None] = print, report: str | None = None) -> int:
    """Read lines until the end; returns the number of searches. report: a log that each search is appended to."""
    session, searches = session or Session(), 0
    write(session.status())
    while True:
        try:
            line = read("> ").strip()
        except (EOFError, KeyboardInterrupt):
            return searches
        if not line:
            continue
        if line.startswith("/"):
            on, answer = command(line, session, catalog.router.shards)
            write(answer)
            if not on:
                return searches
            continue
        outcome = catalog.search_text(line, top_k=session.top_k, probe_shards=session.probe_shards, all_results=session.all_results, filters=session.filters)
        searches += 1
        if report:
            catalog.log_evaluation(outcome, report)
        results = outcome.results.persist()
        count, at = results.count(), 1
        write(f"{count} rezultate")
        while (at - 1) * session.page_size < count:
            for r in page(results, at, session.page_size).orderBy("rank").collect():
                write(f"{r['rank']}. {r['title']} | {format_price(r['price_ron'])} | {r['score']:.4f}")
            at += 1
            if (at - 1) * session.page_size >= count:
                break
            try:
                if read("Enter = pagina următoare, q = stop ").strip().casefold() in ("q", "stop"):
                    break
            except (EOFError, KeyboardInterrupt):
                return searches
        results.unpersist()
