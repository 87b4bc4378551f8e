"""Commands: tell edits a base file, ask queries it, repl does both in a loop.

Exit codes: 0 success or derivable, 1 an error, 2 not derivable. A batch has the worst of its lines, an error
before a query that is not derivable.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile import __version__
from turnstile.functions import columns as C
from turnstile.operators.base import Base
from turnstile.plans import responses
from turnstile.plans.explain import explain
from turnstile.sources import files

log = logging.getLogger(__name__)
SUCCESS, ERROR, NOT_DERIVABLE = 0, 1, 2
HELP = """Commands:
  tell A, B |~ C, D      add a consequence
  tell atom X "note"     add an atom, with a note if there is one
  tell schema TYPE A B   register a schema (ontology mode)
  ask A, B => C, D       query a sequent
  trace on | trace off   show proof traces
  show | show schemas | show individuals
  save FILE | load FILE
  help | quit"""


def session() -> SparkSession:
    """The active session, or a small local one for work at a terminal."""
    return SparkSession.getActiveSession() or SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


class Voice:
    """Where results and errors go: text, compact JSON lines, or nowhere."""

    def __init__(self, as_json: bool = False, quiet: bool = False):
        self.json, self.quiet = as_json, quiet

    def say(self, text: str, data: dict) -> None:
        if self.json:
            print(json.dumps(data, separators=(",", ":")))
        elif not self.quiet:
            print(text)

    def error(self, text: str) -> int:
        if self.json:
            self.say("", {"error": text})
        elif not self.quiet:
            print(f"Error: {text}", file=sys.stderr)
        return ERROR


def typed(spark: SparkSession, lines: list[str]) -> DataFrame:
    return files.kept_lines(spark.createDataFrame(list(enumerate(lines)), "qid int, value string"))


def show_set(texts) -> str:
    return "{" + ", ".join(sorted(texts)) + "}"


def noted(text: str, note: str | None) -> str:
    return f"{text} — {note}" if note else text


def told(base: Base, rows: DataFrame, path: str) -> list:
    """Apply typed statements to a base; what is said of each, in order. Those that are not valid change nothing."""
    own = files.checked(files.statements(rows), base).cache()
    try:
        said = responses.tell_lines(own, path).orderBy("qid").collect()
        if any(not r.code for r in said):
            files.apply(base, own)
            for t in files.TABLES:
                setattr(base, f"_{t}", base.spark.createDataFrame(getattr(base, f"_{t}").collect(), getattr(base, f"_{t}").schema))  # a base file is one document
    finally:
        own.unpersist()
    return said


def emitted(voice: Voice, r) -> int:
    if r.error:
        return voice.error(r.error)
    voice.say(r.text, json.loads(r.json))
    return r.code


def opened(args, spark: SparkSession) -> Base:
    if os.path.exists(args.base):
        return files.load(spark, f"file://{os.path.abspath(args.base)}", args.onto)
    if getattr(args, "create", False):
        return Base(spark, onto=args.onto)
    hint = " Use --create to create it." if hasattr(args, "create") else ""
    raise FileNotFoundError(f"Base file {args.base} does not exist.{hint}")


def given_lines(args, spark: SparkSession, one: str | None) -> DataFrame:
    """The batch's lines, or the single one; '-' reads standard input."""
    if args.batch == "-":
        return typed(spark, sys.stdin.read().splitlines())
    if args.batch is not None:
        if not os.path.exists(args.batch):
            raise FileNotFoundError(f"No such file: {args.batch}")
        return files.lines(spark, f"file://{os.path.abspath(args.batch)}")
    if one is None:
        raise ValueError("Nothing to do: give a line, or --batch.")
    return typed(spark, [sys.stdin.readline().rstrip("\n") if one == "-" else one])


def run_tell(args, spark: SparkSession) -> int:
    voice = Voice(args.json, args.quiet)
    try:
        base = opened(args, spark)
        rows = given_lines(args, spark, args.statement)
    except (OSError, ValueError) as e:
        return voice.error(str(e))
    codes = [emitted(voice, r) for r in told(base, rows, args.base)]
    if args.batch is not None or ERROR not in codes:
        files.save(base, args.base)
        log.info("Saved base to %s", args.base)
    return ERROR if ERROR in codes else SUCCESS


def sequent_rows(rows: DataFrame) -> DataFrame:
    sides = F.split("value", "=>", 2)
    return rows.select("qid", F.col("value").contains("=>").alias("fine"), C.split_members(sides[0]).alias("antecedent"), C.split_members(F.coalesce(F.get(sides, F.lit(1)), F.lit(""))).alias("consequent"))


def run_ask(args, spark: SparkSession) -> int:
    """Answers with their search, which stops at --max-depth."""
    voice = Voice(args.json, args.quiet)
    try:
        base = opened(args, spark)
        rows = sequent_rows(given_lines(args, spark, args.sequent))
    except (OSError, ValueError) as e:
        return voice.error(str(e))
    good, bad = rows.where("fine"), rows.where("not fine").withColumn("error", F.lit(responses.INVALID))
    lines = responses.ask_lines(explain(good, base, args.max_depth).unionByName(bad, allowMissingColumns=True), args.trace)
    codes = [emitted(voice, r) for r in lines.orderBy("qid").collect()]
    log.info("Answered %d queries", len(codes))
    return ERROR if ERROR in codes else max(codes, default=SUCCESS)


def shown(base: Base, what: str) -> str:
    if what == "schemas":
        rows = base.shown_schemas().collect()
        return "\n".join([f"Schemas ({len(rows)}):", *(noted(f"  {r.type}: {r.pattern}", r.annotation) for r in rows)])
    if what == "individuals":
        names = {r.kind: r.names for r in base.shown_vocab().collect()}
        return "\n".join(f"{k.capitalize()}s: {names.get(k, [])}" for k in ("individual", "concept", "role"))
    atoms, rules = base.shown_language().collect(), base.consequences.orderBy("antecedent", "consequent").collect()
    return "\n".join([f"Language ({len(atoms)} atoms):", *(noted(f"  {r.atom}", r.description) for r in atoms), f"Consequences ({len(rules)}):", *(f"  {show_set(r.antecedent)} |~ {show_set(r.consequent)}" for r in rules)])


class Loop:
    """A base being worked on; answer() takes a line and returns what to print, or None to end."""

    def __init__(self, spark: SparkSession, base: Base):
        self.spark, self.base, self.trace = spark, base, False

    def answer(self, line: str) -> str | None:
        line = line.strip()
        head, _, rest = line.partition(" ")
        rest = rest.strip()
        if line in ("quit", "exit"):
            return None
        if not line:
            return ""
        if line == "help":
            return HELP
        if head == "show" and rest in ("", "schemas", "individuals") and (self.base.onto or not rest):
            return shown(self.base, rest)
        if head == "trace" and rest:
            if rest.lower() not in ("on", "off"):
                return "Usage: trace on/off"
            self.trace = rest.lower() == "on"
            return f"Trace: {rest.upper()}"
        if head == "save" and rest:
            try:
                files.save(self.base, rest)
            except OSError as e:
                return f"Error saving: {e}"
            return f"Saved to {rest}"
        if head == "load" and rest:
            try:
                if not os.path.exists(rest):
                    raise FileNotFoundError(f"No such file: {rest}")
                self.base = files.load(self.spark, f"file://{os.path.abspath(rest)}", self.base.onto)
            except (OSError, ValueError) as e:
                return f"Error loading: {e}"
            return f"Loaded from {rest}"
        if head == "tell" and rest:
            return self.tell(rest)
        if head == "ask" and rest:
            return self.ask(rest)
        return f"Unknown command: {line!r}. Type 'help' for commands."

    def tell(self, text: str) -> str:
        if text.startswith("schema ") and self.base.onto and len(files.re_words(text)) != 4:
            return "Usage: tell schema TYPE A B, TYPE one of subClassOf range domain subPropertyOf disjointWith disjointProperties jointCommitment"
        said = [f"Error: {r.error}" if r.error else r.text for r in told(self.base, typed(self.spark, [text]), "")]
        return "\n".join(said).replace("Added consequence:", "Added:")

    def ask(self, text: str) -> str:
        row = explain(sequent_rows(typed(self.spark, [text])), self.base).first()
        if not row.fine:
            return 'Error: Invalid sequent: expected "A, B => C, D".'
        if row.error:
            return f"Error: {row.error}"
        out = ["DERIVABLE" if row.derivable else "NOT DERIVABLE"]
        if self.trace:
            out += [f"  {t}" for t in row.trace] + [f"  Depth: {row.depth_reached}, Cache hits: {row.cache_hits}"]
        return "\n".join(out)


def run_repl(args, spark: SparkSession) -> int:
    if args.base and os.path.exists(args.base):
        base = files.load(spark, f"file://{os.path.abspath(args.base)}", args.onto)
        print(f"Loaded base from {args.base}")
    else:
        base = Base(spark, onto=args.onto)
        print(f"Base file {args.base} not found, starting with empty base." if args.base else "Starting with empty base.")
    loop = Loop(spark, base)
    try:
        while (out := loop.answer(input("turnstile[onto]> " if args.onto else "turnstile> "))) is not None:
            if out:
                print(out)
    except EOFError:
        print()
    except KeyboardInterrupt:
        print("\nInterrupted.")
    return SUCCESS


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="turnstile", description="Nonmonotonic multi-succedent sequents over tables")
    top.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    commands = top.add_subparsers(dest="command")
    for name, line in (("tell", "statement"), ("ask", "sequent")):
        p = commands.add_parser(name)
        p.add_argument("-b", "--base", required=True, help="JSON base file")
        p.add_argument(line, nargs="?", help="one line, or - for standard input")
        p.add_argument("--batch", metavar="FILE", help="lines of a file, or - for standard input")
        p.add_argument("--onto", action="store_true", help="ontology mode")
        out = p.add_mutually_exclusive_group()
        out.add_argument("--json", action="store_true")
        out.add_argument("-q", "--quiet", action="store_true")
        if name == "tell":
            p.add_argument("--create", action="store_true", help="create a missing base file")
        else:
            p.add_argument("--trace", action="store_true")
            p.add_argument("--max-depth", type=int, default=25)
    p = commands.add_parser("repl")
    p.add_argument("-b", "--base")
    p.add_argument("--onto", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command is None:
        parser().print_help()
        return SUCCESS
    return {"tell": run_tell, "ask": run_ask, "repl": run_repl}[args.command](args, session())


if __name__ == "__main__":
    sys.exit(main())
