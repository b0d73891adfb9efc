"""Factor expressions: their graph, their text form and how they become stages of columns."""
