import __spark_entry__ as entry
from wayfare.operators import learning


def test_predictions_train_with_the_settings_of_the_module(spark, monkeypatch):
    built, real = [], learning.perceptron
    monkeypatch.setattr(learning, "perceptron", lambda *args: built.append(real(*args)) or built[-1])
    assert entry.queries()["mlp_predictions"](spark, "/root/testdata/sf0.001").count() > 0
    (model,) = built
    assert model.getMaxIter() == learning.ITERATIONS == 400
    assert (model.getLayers()[:3], model.getTol(), model.getBlockSize(), model.getSeed()) == ([64, 12, 6], 1e-6, 128, 1234)
