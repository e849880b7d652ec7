"""Structure of source code: a parser for JavaScript and TypeScript, extraction, nesting, boundaries."""
