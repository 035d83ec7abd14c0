"""weirflow: programmable batch dataflows as Spark DataFrame plans."""
