"""Trade sources and table stores."""
