"""gneiss: code and document intelligence as DataFrame operators on Spark."""
