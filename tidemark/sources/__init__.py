"""Tables in a shared folder, and readers of other layouts."""
