"""Reading documents, components and vectors; writing results."""
