"""Programs: one command a line (RECODE and IF run to their END), run against named tables.

A session holds a base relation and, lazily, what was selected and how it is sorted; commands that report append to
``reports`` and return their result as a DataFrame. READ starts afresh: selection, sort, variables, groups and result
tables go.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import matched, quality, relational, survey, tabulate
from cohortlab.plans.expressions import condition, evaluate, field_named, parse
from cohortlab.sources import writers

WORD = re.compile(r'"[^"]*"|\[[^\]]+\]|\S+')
#: Runs that a session remembers.
HISTORY = 100
OPTION = re.compile(r'(?i)\b([A-Z]+)\s*=\s*("[^"]*"|\S+)')


class ProgramError(ValueError):
    pass


def name_of(word: str) -> str:
    return word[1:-1] if word[:1] in '["' else word


@dataclass
class Session:
    spark: SparkSession
    tables: dict[str, DataFrame]
    order: dict[str, list[str]] = field(default_factory=dict)  # a table's natural order: its key
    base: DataFrame | None = None
    row_order: list[str] = field(default_factory=list)
    selections: list[str] = field(default_factory=list)
    sorting: list[tuple[str, bool]] = field(default_factory=list)
    variables: dict[str, object] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    groups: dict[str, list[str]] = field(default_factory=dict)
    base_name: str = ""
    source_order: bool = False  # CANCEL SORT asks for it
    history: list[tuple[str, str, str]] = field(default_factory=list)  # the last runs: when, first line, outcome
    outtables: dict[str, DataFrame] = field(default_factory=dict)
    archive: DataFrame | None = None
    with_missing: bool = False
    missing_label: str = "(.)"
    reports: list[tuple[str, object]] = field(default_factory=list)
    prompts: Callable[[str], object] = lambda prompt: None

    # Relations ------------------------------------------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        for known in (self.outtables, self.tables):
            for k, df in known.items():
                if k.lower() == name.lower():
                    return df
        raise ProgramError(f"no table {name}")

    @property
    def active(self) -> DataFrame:
        if self.base is None:
            raise ProgramError("READ a table first")
        df = self.base
        for text in self.selections:
            df = df.where(condition(df, text, self.variables))
        return df

    @property
    def sorted(self) -> DataFrame:
        if self.sorting:
            return relational.sort(self.active, self.sorting, *self.row_order[:1])
        return self.active.orderBy(*self.row_order) if self.source_order and self.row_order else self.active

    def fields(self, words: list[str], df: DataFrame | None = None) -> list[str]:
        """A field list: names, groups, * and * EXCEPT."""
        df = self.active if df is None else df
        if words and words[0] == "*":
            left_out = {w.lower() for w in self.fields(words[2:], df)} if len(words) > 1 and words[1].upper() == "EXCEPT" else set()
            return [c for c in df.columns if c.lower() not in left_out]
        out: list[str] = []
        for w in map(name_of, words):
            for one in self.groups.get(w.lower(), [w]):
                found = field_named(df, one)
                if found not in out:
                    out.append(found)
        return out

    # Programs -------------------------------------------------------------------------------------------------

    def run(self, program: str) -> DataFrame | None:
        """Runs every command; the result is that of the last that has one. The history keeps the last 100 runs."""
        lines = [x.strip() for x in program.splitlines()]
        lines = [x for x in lines if x and not x.startswith("*")]
        began, outcome = datetime.now(timezone.utc).isoformat(timespec="seconds"), "failed"
        try:
            last = self._run(lines)
            outcome = "completed"
            return last
        finally:
            self.history = [*self.history, (began, lines[0] if lines else "", outcome)][-HISTORY:]

    def run_history(self) -> DataFrame:
        return self.spark.createDataFrame(self.history, "started string, first_line string, outcome string")

    def _run(self, lines: list[str]) -> DataFrame | None:
        last = None
        at = 0
        while at < len(lines):
            line = lines[at]
            at += 1
            if re.match(r"(?i)(RECODE|IF)\b", line):
                block = [line]
                while not re.search(r"(?i)\bEND$", block[-1]):
                    if at == len(lines):
                        raise ProgramError(f"{line.split()[0]} without END")
                    block.append(lines[at])
                    at += 1
                result = self.recode(block) if line[:6].upper() == "RECODE" else self.branch(" ".join(block))
            else:
                result = self.command(line)
            last = result if result is not None else last
        return last

    def command(self, line: str) -> DataFrame | None:
        word, _, rest = line.partition(" ")
        action = getattr(self, f"do_{word.lower()}", None)
        if action is None:
            raise ProgramError(f"{word} is not a command")
        return action(rest.strip())

    def _options(self, text: str) -> tuple[list[str], dict[str, str]]:
        options = {k.upper(): name_of(v) for k, v in OPTION.findall(text)}
        return WORD.findall(OPTION.sub("", text)), options

    def _report(self, kind: str, result):
        self.reports.append((kind, result))
        return result

    # Commands -------------------------------------------------------------------------------------------------

    def do_read(self, rest):
        name = name_of(rest.rpartition(":")[2].strip())
        self.base, self.base_name, self.source_order = self.table(name), name, False
        self.row_order = self.order.get(name.lower(), [])
        self.selections, self.sorting, self.variables, self.types, self.groups, self.outtables = [], [], {}, {}, {}, {}

    def do_select(self, rest):
        if rest:
            condition(self.active, rest, self.variables)  # errors show here
            self.selections = [*self.selections, rest]
        else:
            self.selections = []

    def do_cancel(self, rest):
        if rest.upper().startswith("SORT"):
            self.sorting, self.source_order = [], True
        else:
            self.selections = []

    def do_sort(self, rest):
        plan: list[tuple[str, bool]] = []
        for w in WORD.findall(rest):
            if w.upper() in ("ASC", "ASCENDING", "DESC", "DESCENDING"):
                plan[-1] = (plan[-1][0], w.upper().startswith("DESC"))
            else:
                plan.append((field_named(self.active, name_of(w)), False))
        self.sorting = plan

    def do_list(self, rest):
        return self._report("LIST", self.sorted.select(*[f"`{f}`" for f in self.fields(WORD.findall(rest) or ["*"])]))

    def do_define(self, rest):
        words = WORD.findall(rest)
        name = words[0].lower()
        if len(words) > 1 and words[1].upper() == "GROUPVAR":
            self.groups[name] = self.fields(words[2:])
            return
        if self.base is not None and name in {c.lower() for c in self.base.columns} or name in self.variables:
            raise ProgramError(f"{words[0]} exists")
        if "=" in words[1:2]:
            self.variables[name] = self._literal(rest.partition("=")[2])
        else:
            kinds = [w.upper() for w in words[1:] if w.upper() not in ("STANDARD", "GLOBAL", "PERMANENT")]
            self.variables[name], self.types[name] = None, kinds[0] if kinds else "TEXTINPUT"

    def do_undefine(self, rest):
        if rest.strip().startswith("*"):
            self.variables, self.types, self.groups = {}, {}, {}
        else:
            for held in (self.variables, self.types, self.groups):
                held.pop(rest.strip().lower(), None)

    def do_assign(self, rest):
        name, _, text = rest.partition("=")
        key = name.strip().lower()
        if key in self.variables:
            value = self._literal(text)
            wanted = {"NUMERIC": (int, float), "YN": bool, "TEXTINPUT": str}.get(self.types.get(key, ""))
            if value is not None and wanted and (not isinstance(value, wanted) or wanted != bool and isinstance(value, bool)):
                raise ProgramError(f"{name.strip()} is {self.types[key]}")
            self.variables[key] = value
            return
        node = parse(text)
        value = evaluate(node, self.active, self.variables)
        column = {"number": value.number, "boolean": value.truth}.get(value.kind, value.text)
        self.base, self.selections = self.active.withColumn(name.strip(), column), []

    def _literal(self, text: str):
        node = parse(text)
        if node.kind == "unary" and node.value == "-" and node.parts[0].kind == "literal":
            return -node.parts[0].value
        if node.kind == "field" and node.value.lower() in self.variables:
            return self.variables[node.value.lower()]
        if node.kind != "literal":
            raise ProgramError("a literal is needed")
        return node.value

    def branch(self, block: str):
        m = re.match(r"(?is)IF\s+(.*?)\s+THEN\s+(.*?)(?:\s+ELSE\s+(.*?))?\s*END$", block)
        if not m:
            raise ProgramError("IF condition THEN command [ELSE command] END")
        one = self.spark.range(1)
        holds = one.select(condition(one, m[1], self.variables)).first()[0]
        chosen = m[2] if holds else m[3]
        return self.command(chosen.strip()) if chosen else None

    def recode(self, block: list[str]):
        m = re.match(r"(?i)RECODE\s+(\S+)\s+TO\s+(\S+)$", block[0])
        if not m:
            raise ProgramError("RECODE source TO target")
        number = lambda t: None if t.upper() in ("LOVALUE", "HIVALUE") else float(t)
        ranges, other = [], None
        for line in block[1:-1]:
            left, _, label = line.partition("=")
            words = left.replace(" - ", " ").split()
            if words[0].upper() == "ELSE":
                other = name_of(label.strip())
            else:
                ranges.append((number(words[0]), number(words[1]), name_of(label.strip())))
        if len(ranges) > 12:
            raise ProgramError("at most 12 ranges")
        rows = self.active
        target = name_of(m[2])
        self.variables.pop(target.lower(), None)
        self.base, self.selections = relational.recode(rows, field_named(rows, name_of(m[1])), target, ranges, other), []

    def do_freq(self, rest):
        words, o = self._options(rest)
        out = None
        for f in self.fields(words):
            if "PSUVAR" in o:
                out = survey.freq(self.active, f, field_named(self.active, o["PSUVAR"]), o.get("STRATAVAR"), o.get("WEIGHTVAR"))
            else:
                stratum = field_named(self.active, o["STRATAVAR"]) if "STRATAVAR" in o else None
                out = tabulate.freq(self.active, f, stratum, self.with_missing)
            self._report(f"FREQ {f}", out)
        if "OUTTABLE" in o:
            self.outtables[o["OUTTABLE"]] = out
        return out

    def do_tables(self, rest):
        words, o = self._options(rest)
        flags = {w.upper() for w in words} & {"FISHER", "ONEISYES"}
        words = [w for w in words if w.upper() not in flags]
        outcome = self.fields([words[-1]])[0]
        strata = self.fields(o["STRATAVAR"].split()) if "STRATAVAR" in o else []
        out = None
        for e in [f for f in self.fields(words[:-1]) if f != outcome]:
            if "PSUVAR" in o:
                out = survey.tables(self.active, e, outcome, field_named(self.active, o["PSUVAR"]), *strata[:1], weight=o.get("WEIGHTVAR"))
            else:
                out = tabulate.tables(self.active, e, outcome, strata, o.get("WEIGHTVAR"), self.with_missing, "ONEISYES" in flags)
                if "FISHER" in flags:
                    self._report(f"FISHER {e} {outcome}", tabulate.fisher_tables(out, strata))
            self._report(f"TABLES {e} {outcome}", out)
            if "OUTTABLE" in o:
                self.outtables[o["OUTTABLE"]] = out if "PSUVAR" in o else tabulate.outtable(out, e, strata)
        return out

    def do_means(self, rest):
        words, o = self._options(rest)
        names = self.fields(words)
        if "PSUVAR" in o:
            out = survey.means(self.active, names[0], field_named(self.active, o["PSUVAR"]), o.get("STRATAVAR"), o.get("WEIGHTVAR"), *names[1:2])
        else:
            out = tabulate.means(self.active, names[0], names[1:] + (self.fields([o["STRATAVAR"]]) if "STRATAVAR" in o else []))
        if "OUTTABLE" in o:
            self.outtables[o["OUTTABLE"]] = out
        return self._report(f"MEANS {rest}", out)

    def do_summarize(self, rest):
        body, o = rest, {k.upper(): name_of(v) for k, v in OPTION.findall(rest)}
        body, _, target = OPTION.sub("", body).rpartition(" TO ")
        wanted = [(r, f.upper(), field_named(self.active, name_of(x)) if x else None) for r, f, x in re.findall(r"(\w+)\s*::\s*(\w+)\s*\(\s*([^)]*?)\s*\)", body)]
        if not wanted or not target.strip():
            raise ProgramError("SUMMARIZE result::function(field) ... TO table")
        strata = self.fields([o["STRATAVAR"]]) if "STRATAVAR" in o else []
        out = tabulate.summarize(self.active, wanted, strata, self.row_order, o.get("WEIGHTVAR"))
        self.outtables[target.strip()] = out
        return self._report("SUMMARIZE", out)

    def _keys(self, text: str) -> tuple[str, list[tuple[str, str]], list[str]]:
        table, _, rest = text.partition(" ")
        pairs = re.findall(r"(\[[^\]]+\]|\w+)\s*::\s*(\[[^\]]+\]|\w+)", rest)
        flags = [w.upper() for w in re.sub(r"\S+\s*::\s*\S+", " ", rest).split() if w.upper() != "AND"]
        return name_of(table), [(name_of(a), name_of(b)) for a, b in pairs], flags

    def do_relate(self, rest):
        table, keys, flags = self._keys(rest)
        right = self.table(table)
        keys = [(field_named(self.active, a), field_named(right, b)) for a, b in keys]
        self.base, self.selections = relational.relate(self.active, right, keys, "ALL" in flags), []

    def do_merge(self, rest):
        table, keys, _ = self._keys(rest)
        source = self.table(table)
        order = self.order.get(table.lower()) or [b for _, b in keys]
        self.base, self.selections = relational.merge(self.active, source, keys, order), []

    def do_delete(self, rest):
        if rest.upper().startswith("TABLES"):
            name = rest.split()[1]
            self.tables[name] = self.table(name).limit(0)
            return
        text = re.sub(r"(?i)\b(PERMANENT|RUNSILENT|SAVEDATA)\b", "", rest).strip()
        rows = self.active
        fits = F.lit(True) if text == "*" else condition(rows, text, self.variables)
        gone = rows.where(fits)
        kept, deleted = relational.delete(self.base, gone, self.row_order or self.base.columns)
        self.archive = deleted if self.archive is None else self.archive.unionByName(deleted)
        self.base = kept

    def do_undelete(self, rest):
        text = re.sub(r"(?i)\bRUNSILENT\b", "", rest).strip()
        if self.archive is None:
            return
        fits = F.lit(True) if text == "*" else condition(self.archive, text, self.variables)
        back, self.archive = self.archive.where(fits), self.archive.where(~fits)
        self.base = self.base.unionByName(back)

    def do_display(self, rest):
        words, o = self._options(rest)
        shown = {w.upper() for w in words} - {"DBVARIABLES"}
        fields = [(self.base_name, c, t) for c, t in self.active.dtypes] if self.base is not None and "DEFINE" not in shown else []
        defined = [("", v, self.types.get(v, "STANDARD")) for v in self.variables] if "FIELDVAR" not in shown else []
        rows = fields + defined
        if "LIST" in shown:
            named = {name_of(w).lower() for w in words[[w.upper() for w in words].index("LIST") + 1 :]}
            rows = [r for r in rows if r[1].lower() in named]
        out = self.spark.createDataFrame(sorted(rows, key=lambda r: (r[0], r[1].lower())), "table string, variable string, type string")
        if "OUTTABLE" in o:
            self.outtables[o["OUTTABLE"]] = out
        return self._report("DISPLAY", out)

    def do_match(self, rest):
        words, o = self._options(rest)
        e, c = self.fields(words[:2])
        return self._report("MATCH", matched.pairs(self.active, e, c, self.fields([o["MATCHVAR"]])[0]))

    def do_logistic(self, rest):
        left, _, right = rest.partition("=")
        words, o = self._options(right)
        terms = [self.fields([w])[0] for w in words if w != "+"]
        y = self.fields([left.strip()])[0]
        return self._report("LOGISTIC", matched.conditional_logistic(self.active, y, terms, self.fields([o["MATCHVAR"]])[0]))

    def do_graph(self, rest):
        words, o = self._options(rest)
        return self._report(f"GRAPH {o.get('GRAPHTYPE', 'Bar')}", tabulate.freq(self.active, self.fields(words)[0], limits=False))

    def do_write(self, rest):
        m = re.match(r'(?i)(REPLACE|APPEND)\s+"?Text"?\s+\{([^}]*)\}\s*:?\s*(\S*)\s*(.*)$', rest)
        if not m or m[1].upper() != "REPLACE":
            raise ProgramError('WRITE REPLACE "Text" {path}:table fields')
        writers.write_csv(self.sorted.select(*self.fields(WORD.findall(m[4]) or ["*"])), m[2])

    def do_set(self, rest):
        key, _, value = rest.partition("=")
        key, value = key.strip().upper(), value.strip()
        if key == "MISSING":
            self.with_missing = value.upper() == "ON"
        elif key == "IGNORE":
            self.with_missing = value.upper() != "ON"
        elif key == "(.)":
            self.missing_label = name_of(value)

    def do_epiai(self, rest):
        words, _ = self._options(rest)
        if words[0].upper() == "QUALITY":
            return self._report("QUALITY", quality.profile(self.active))
        raise ProgramError(f"{rest} is offered by the operators, not by programs")

    def do_header(self, rest):
        self.reports.append(("HEADER", rest))

    def do_typeout(self, rest):
        self.reports.append(("TYPEOUT", name_of(rest)))

    def do_routeout(self, rest):
        self.reports.append(("ROUTEOUT", name_of(rest.split()[0])))

    def do_closeout(self, rest):
        self.reports.append(("CLOSEOUT", ""))

    def do_printout(self, rest):
        self.reports.append(("PRINTOUT", rest))

    def do_dialog(self, rest):
        words = WORD.findall(rest)
        answer = self.prompts(name_of(words[0]))
        if len(words) > 1:
            self.variables[words[1].lower()] = answer

    def do_beep(self, rest):
        self.reports.append(("BEEP", ""))
