"""Curation of question-SQL pairs as Spark jobs: tables in, tables out."""
