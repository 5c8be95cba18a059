"""Lexers and local grammars for problem 4, one module per family of languages."""
