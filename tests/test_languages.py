"""The guess of a source text's language, on texts written after the marks were chosen."""

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions.languages import guess_language
from sparkfolio.functions.text import source_language

TEXTS = {
    "python": "from pathlib import Path\n\n\nclass Shelf:\n    def __init__(self, root):\n        self.root = Path(root)\n\n    def books(self):\n        for p in self.root.iterdir():\n            if p.suffix != '.txt':\n                continue\n            yield p\n",
    "javascript": "'use strict';\nconst fs = require('fs');\nfunction load(name) {\n  if (typeof name === 'undefined') { return null; }\n  return fs.readFileSync(name).toString();\n}\nmodule.exports = { load };\n",
    "typescript": "import { Shelf } from './shelf';\n\nexport interface Book {\n  title: string;\n  pages?: number;\n}\n\nexport const longest = (books: Book[]): Book | undefined => books.sort((a, b) => b.pages - a.pages)[0];\n",
    "java": "package org.shelf;\n\nimport java.util.List;\n\npublic class Shelf {\n    private final List<String> books;\n\n    @Override\n    public String toString() { return books.toString(); }\n}\n",
    "c": "#include <stdio.h>\n\nstruct book { char *title; int pages; };\n\nint main(void) {\n    struct book b = { \"x\", 3 };\n    printf(\"%s %d\\n\", b.title, b.pages);\n    return 0;\n}\n",
    "cpp": "#include <vector>\n#include <string>\n\nnamespace shelf {\nclass Shelf {\npublic:\n    void add(const std::string& title) { books_.push_back(title); }\nprivate:\n    std::vector<std::string> books_;\n};\n}\n",
    "csharp": "using System;\n\nnamespace Library\n{\n    public class Book\n    {\n        public string Title { get; set; }\n        public void Show() => Console.WriteLine(Title);\n    }\n}\n",
    "go": "package shelf\n\nimport \"fmt\"\n\ntype Book struct {\n\tTitle string\n}\n\nfunc (b *Book) Show() error {\n\t_, err := fmt.Println(b.Title)\n\tif err != nil {\n\t\treturn err\n\t}\n\treturn nil\n}\n",
    "rust": "use std::fs;\n\n#[derive(Debug)]\npub struct Book {\n    title: String,\n}\n\nimpl Book {\n    pub fn title(&self) -> &str {\n        &self.title\n    }\n}\n",
    "ruby": "require 'json'\n\nclass Shelf\n  attr_reader :books\n\n  def titles\n    books.each do |b|\n      puts b.title unless b.nil?\n    end\n  end\nend\n",
    "php": "<?php\nclass Shelf {\n    public function add($book) {\n        $this->books[] = $book;\n        echo $book;\n    }\n}\n",
    "shell": "set -e\nOUT=\"$HOME/out\"\nif [ ! -d \"$OUT\" ]; then\n  mkdir -p \"$OUT\"\nfi\nfor f in *.txt; do\n  cp \"$f\" \"$OUT\"\ndone\n",
    "sql": "CREATE TABLE books (id integer PRIMARY KEY, title varchar(80) NOT NULL);\n\nSELECT title, count(*)\nFROM books\nGROUP BY title;\n",
    "css": "@media print {\n  .menu { display: none; }\n}\nbody {\n  margin: 0;\n  color: #333333;\n  font-size: 14px;\n}\n",
    "html": "\n<!DOCTYPE html>\n<html><body><p>Hello</p></body></html>",
    "xml": '<?xml version="1.0"?>\n<shelf><book/></shelf>',
    "json": '{"books": [{"title": "x", "pages": 3}]}',
    "yaml": "# a shelf\nbooks:\n  - title: x\n    note: |\n      any text, at length\n  - title: y\nopen: true\n",
    "toml": "# a shelf\n[shelf]\nname = \"x\"\nrows = 3\n\n[shelf.owner]\nname = 'y'\n",
    "markdown": "# Shelf\n\nAll [books](https://example.org/books) of the *house*:\n\n- one\n- two\n\n```\nls\n```\n",
}
#: No source: prose that has some marks, too.
PROSE = ["", "   \n\t\n", None, "Import duties are low. While we wait: nothing. Return soon; select a book from the shelf where it stands.", "Dear all,\n\nfor each of you, if time permits:\n- bring a book\n\nYours", "1 + 1 = 2", "{not json", "Note: this is one line", "x" * 200_000, "(a: " * 50_000, "\n" * 100_000]


def test_guess(spark):
    rows = [*TEXTS.items(), *((None, t) for t in PROSE)]
    df = spark.createDataFrame(rows, "language string, content string")
    found = df.withColumn("guess", guess_language(F.col("content"))).collect()
    assert [(r["language"], r["guess"]) for r in found if r["language"] != r["guess"]] == []


@pytest.mark.parametrize("name, kind, content, wanted", [("a.py", None, TEXTS["go"], "python"), ("a", "text/x-rust", TEXTS["go"], "rust"), ("a", "text/plain", TEXTS["go"], "go"), (None, None, "#!/usr/bin/env node\n" + TEXTS["python"], "javascript"), ("a.txt", None, PROSE[3], "text"), (None, None, None, "text")])
def test_name_and_type_come_first(spark, name, kind, content, wanted):
    df = spark.createDataFrame([(name, kind, content)], "name string, kind string, content string")
    assert df.select(source_language(F.col("name"), F.col("kind"), F.col("content"))).first()[0] == wanted


def test_no_document_is_taken_for_source(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert docs.filter(guess_language(F.col("text")).isNotNull()).count() == 0
