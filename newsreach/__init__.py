"""newsreach: announcement analytics as Spark DataFrame operators."""
